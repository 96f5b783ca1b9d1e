"""Names, instructions and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide results.
VERBS = ("turn off", "turn on", "pick up", "pick", "take out", "take", "put down", "put", "place", "move", "slide", "use",
         "open", "close", "grab", "lift", "pull", "push")
BOUNDARIES = ("out of", "into", "inside", "onto", "from", "closer to", "next to", "away from", "to", "in", "on", "off",
              "then", "and then", "and finally", "and", "finally", "using", "with")
ARTICLES = ("the", "a", "an", "one", "two", "three", "four")
INSTRUCTION_STEPS = (
    (r"^(?:kitchen|living room|study)\s+scene\s*\d+\s+", ""),
    (r"(?:\s+demo)?\s+tracks?\s*$", ""),
    (r"(?:\s|_)+(?:demo(?:\s|_)+demo|\bdemo)\s*\d+\s*$", ""),
    (r"(?:\s|_)+demo\s*$", ""),
    (r"\s+", " "),
)
FAMILY_MARKS = {
    "maniskill": ("maniskill", "pickcube", "pushcube", "stackcube"),
    "libero": ("libero", "kitchen_scene", "living_room_scene", "study_scene"),
}
PARAM_GROUPS = {
    "vision_encoder": ("encoder.siglip_model.vision_model", "encoder.dinov2_model", "encoder.frame_pos_embed", "encoder.temporal_q",
                       "encoder.temporal_k", "encoder.motion_ln", "encoder.motion_scale", "encoder.img_proj"),
    "text_encoder": ("encoder.siglip_model.text_model", "encoder.txt_proj"),
    "perceiver_3d": ("feat_3d_head",),
    "flow_dit": ("dit",),
}


def normalize_instruction(c: Column) -> Column:
    out = F.trim(F.regexp_replace(F.lower(c), "_", " "))
    for pattern, repl in INSTRUCTION_STEPS:
        out = F.regexp_replace(out, pattern, repl)
    return F.trim(out)


def task_slug(c: Column, default: str = "video") -> Column:
    s = F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", default).otherwise(s)


def dirname(c: Column, max_len: int = 120) -> Column:
    """Slug of the normalised instruction; a long one keeps its head plus eight digits of its hash."""
    key = normalize_instruction(c)
    key = F.when(key == "", "unknown task").otherwise(key)
    safe = F.btrim(F.regexp_replace(key, "[^a-z0-9]+", "_"), F.lit("_"))
    safe = F.when(safe == "", "unknown_task").otherwise(safe)
    digest = F.substring(F.sha1(safe), 1, 8)
    head = F.rtrim(F.substring(safe, 1, max_len - 9), F.lit("_"))
    return F.when(F.length(safe) <= max_len, safe).otherwise(F.concat(head, F.lit("_"), digest))


def sanitize(c: Column, max_len: int = 180) -> Column:
    return F.substring(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), F.lit("_")), 1, max_len)


def slugify(c: Column, max_len: int = 96) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    return F.btrim(F.substring(F.when(s == "", "task").otherwise(s), 1, max_len), F.lit("_"))


def object_phrase(c: Column) -> Column:
    """What an instruction is about: without its verb, up to the first boundary word, without article or number."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[.!?]+$", ""), r"\s+", " ")
    t = F.trim(F.regexp_replace(t, rf"^\s*(?:{'|'.join(VERBS)})\s+(.*)$", "$1"))
    t = F.btrim(F.get(F.split(t, rf"\b(?:{'|'.join(BOUNDARIES)})\b", 2), F.lit(0)), F.lit(" ,"))
    return F.trim(F.regexp_replace(t, rf"^(?:{'|'.join(ARTICLES)})\s+", ""))


def truncate_words(c: Column, n: int) -> Column:
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def resolve_prompt(found: Column, prompt: str | None, task: Column, max_words: int | None, prefix: str = "") -> Column:
    """Prompt of a table, else the fixed one, else the first words of the task text (slashes part words), else ``object``; a prefix
    ends with a full stop. ``max_words`` None leaves the task text out."""
    candidates = [F.nullif(F.trim(found), F.lit(""))]
    if prompt:
        candidates.append(F.lit(prompt.strip()))
    if max_words is not None:
        candidates.append(F.when(F.coalesce(task, F.lit("")) != "", truncate_words(F.translate(task, "/", " "), max_words)))
    value = F.coalesce(*candidates, F.lit("object"))
    head = prefix.strip()
    return F.trim(F.concat(F.lit(head if head.endswith(".") else head + "."), F.lit(" "), value)) if head else value


def count_items(c: Column) -> Column:
    return F.size(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""))


def family(path: Column, default: str = "real") -> Column:
    """Dataset family of a path; consumers differ in the default (real or libero)."""
    low = F.lower(path)
    out = F.lit(default)
    for name, marks in reversed(list(FAMILY_MARKS.items())):
        hit = F.lit(False)
        for m in marks:
            hit = hit | low.contains(m)
        out = F.when(hit, name).otherwise(out)
    return out


def param_group(name: Column) -> Column:
    out = F.lit("others")
    for group, prefixes in reversed(list(PARAM_GROUPS.items())):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | name.startswith(p)
        out = F.when(hit, group).otherwise(out)
    return out


def natural_key(c: Column) -> list[Column]:
    """Sort key of ids with a number after the last underscore: numbered ones first and by number, then text."""
    n = F.substring_index(c, "_", -1).try_cast("bigint")
    digits = F.substring_index(c, "_", -1).rlike(r"^\d+$")
    return [F.when(digits, 0).otherwise(1), F.when(digits, n), c]


def parse_indices(c: Column) -> Column:
    """Array of integers of a list such as "1,5;7"; blanks are skipped."""
    parts = F.filter(F.split(F.translate(c, ";", ","), ","), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.trim(x).cast("int"))


def name_fields(stem: Column) -> dict[str, Column]:
    """task text and slug, success mark and environment id hidden in a file name (NULL when absent)."""
    def field(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(stem, pattern, 1), F.lit(""))

    task = F.coalesce(F.trim(field(r"task=(.+?)(?:--success=|$)")), stem)
    slug, success, env = task_slug(task), field(r"--success=([^-\s]+)"), field(r"--env_id([^-\s]+)")
    out = F.concat(F.concat_ws("__", slug, F.concat(F.lit("success_"), success), F.concat(F.lit("env_id_"), env)), F.lit(".hdf5"))
    return {"task_text": task, "task_slug": slug, "success": success, "env_id": env, "out_name": out}
