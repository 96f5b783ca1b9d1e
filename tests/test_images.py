"""Images are made once per frame, in several tasks a core."""

import pytest

from pathweave.plans import load_all
from pathweave.plans.fixtures import Data
from pathweave.session import prepare


def test_frames_are_dealt_out_before_images_are_made(spark):
    d = Data(prepare(spark), "/root/testdata/sf0.001")
    for images in (d.depth_images(), d.mask_images()):
        assert images.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        assert images.count() == d.table("events").count()


@pytest.mark.parametrize("name", ["w29_sample_mask_points", "p18_mask_top_cut", "h12_depth_units"])
def test_images_are_not_made_again_for_a_filter(spark, sf_dir, name):
    plan = load_all()[name].run(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "lambdafunction" in line]
    if name == "w29_sample_mask_points":
        assert plan.count("mrep") == 1


@pytest.mark.parametrize("name", ["j11_bilinear_depth", "j12_patch_depth_min", "j12_patch_depth_median", "j13_patch_depth_temporal", "h25_scene_cloud"])
def test_points_and_images_share_the_numbered_frames(spark, sf_dir, name):
    """Frames are numbered once: the plan neither reads the events again nor numbers them for the points and for the images."""
    plan = load_all()[name].run(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "event_type" not in plan


def test_long_generated_methods_are_left_to_the_compiler(spark, sf_dir):
    load_all()["j12_patch_depth_min"].run(spark, sf_dir)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
