"""Source headers and licence texts of more than one line, for ``licenses.scan``.

Long texts (Apache, GNU, Mozilla, Creative Commons) are known by their title and first words, short ones (MIT, ISC, BSD) are whole.
"""

from __future__ import annotations

_GNU = (("GPL-1.0", "General", "1", "1, February 1989"), ("GPL-2.0", "General", "2", "2, June 1991"), ("GPL-3.0", "General", "3", "3, 29 June 2007"),
        ("LGPL-2.0", "Library General", "2", "2, June 1991"), ("LGPL-2.1", "Lesser General", "2.1", "2.1, February 1999"), ("LGPL-3.0", "Lesser General", "3", "3, 29 June 2007"),
        ("AGPL-3.0", "Affero General", "3", "3, 19 November 2007"))
_GNU_TITLE = "GNU {} Public License Version {}"
_GFDL = (("GFDL-1.1", "1.1, March 2000"), ("GFDL-1.2", "1.2, November 2002"), ("GFDL-1.3", "1.3, 3 November 2008"))
_VERBATIM = (" Copyright (C) {} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document,"
             " but changing it is not allowed.")
_GNU_HEADER = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software"
    " Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT"
    " ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} Public License for more details.")
_GNU_SHORT = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software"
              " Foundation, either version {} of the License, or (at your option) any later version.")
_GNU_ONLY = "you can redistribute it and/or modify it under the terms of the GNU {} Public License version {} as published by the Free Software Foundation."
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the"
    " License at http://www.apache.org/licenses/LICENSE-2.0")
_APACHE_REST = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
    " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.")
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one"
        " at http://mozilla.org/MPL/2.0/.")
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the"
    " Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
    " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission"
    " notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR"
    " IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION"
    " WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and"
    " this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL"
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES"
    " WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH"
    " THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of"
    " source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above"
    " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_3 = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific"
          " prior written permission.")
_BSD_REST = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED"
    " WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,"
    " INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR"
    " PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)"
    " ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_OWNER = "Copyright (c) All rights reserved. "

#: License and text.
FORMS = (
    *((name, _GNU_TITLE.format(kind, dated) + _VERBATIM.format(dated[-4:])) for name, kind, _, dated in _GNU),
    *((name, f"GNU Free Documentation License Version {dated}" + _VERBATIM.format("2000")) for name, dated in _GFDL),
    *((name, _GNU_HEADER.format(kind, v, kind)) for name, kind, v, _ in _GNU),
    *((name, _GNU_SHORT.format(kind, v)) for name, kind, v, _ in _GNU),
    *((name, _GNU_ONLY.format(kind, v)) for name, kind, v, _ in _GNU),
    ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE + _APACHE_REST),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("MPL-2.0", _MPL), ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to"
                        " the creation of, or owns Covered Software."),
    ("MPL-1.1", "Mozilla Public License Version 1.1 1. Definitions. 1.0.1. \"Commercial Use\" means distribution or otherwise making the Covered Code available to a third party."),
    ("MIT", _MIT), ("MIT", "MIT License Copyright (c) " + _MIT), ("ISC", _ISC), ("ISC", "ISC License Copyright (c) " + _ISC),
    ("BSD-2-Clause", _BSD_2 + _BSD_REST), ("BSD-2-Clause", _OWNER + _BSD_2 + _BSD_REST),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_REST), ("BSD-3-Clause", _OWNER + _BSD_2 + _BSD_3 + _BSD_REST),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
