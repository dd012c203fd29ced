"""Templates of the licence scan by SPDX id: one-line statements, notices of files, short and full texts.

Versions and variants of a family are templates of their own, so that the closest one is reported. The full
texts are the files of ``license_texts``.
"""

from __future__ import annotations

from pathlib import Path

_FOLDER = Path(__file__).with_name("license_texts")

#: The families of the GNU licences: id, name in texts, versions.
_GNU = (
    ("GPL", "GNU General Public License", ("1", "2", "3")),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
    ("LGPL", "GNU Library General Public License", ("2",)),
    ("AGPL", "GNU Affero General Public License", ("1", "3")),
)

_CC = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)

#: Licences that lines name in the manner of "Released under the MIT License." and "Licensed under the ...".
_NAMED = (
    ("0BSD", "BSD Zero Clause License"),
    ("AFL-3.0", "Academic Free License, version 3.0"),
    ("Artistic-1.0", "Artistic License 1.0"),
    ("Artistic-2.0", "Artistic License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-4-Clause", "BSD 4-Clause License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("CDDL-1.0", "Common Development and Distribution License, Version 1.0"),
    ("CPL-1.0", "Common Public License, Version 1.0"),
    ("EPL-1.0", "Eclipse Public License, Version 1.0"),
    ("EPL-2.0", "Eclipse Public License, Version 2.0"),
    ("EUPL-1.2", "European Union Public Licence, Version 1.2"),
    ("ISC", "ISC License"),
    ("MIT-0", "MIT No Attribution License"),
    ("MPL-1.1", "Mozilla Public License, Version 1.1"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("MS-PL", "Microsoft Public License"),
    ("NCSA", "University of Illinois NCSA Open Source License"),
    ("ODbL-1.0", "Open Database License, Version 1.0"),
    ("OFL-1.1", "SIL Open Font License, Version 1.1"),
    ("PSF-2.0", "Python Software Foundation License, Version 2"),
    ("WTFPL", "Do What The Fuck You Want To Public License, Version 2"),
    ("Zlib", "zlib License"),
)

_GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as "
    "published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
    "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for "
    "more details. You should have received a copy of the {name} along with this program. If not, see "
    "https://www.gnu.org/licenses/."
)
_GNU_ONLY = _GNU_NOTICE.replace(
    "either version {version} of the License, or (at your option) any later version.", "version {version} of the License."
)

_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_NAME = (
    "{nth}. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission. "
)
_BSD_ADVERT = (
    "3. All advertising materials mentioning features or use of this software must display the following "
    "acknowledgement: This product includes software developed by the organization. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

_SHORT = (
    ("BSD-2-Clause text", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause text", _BSD_HEAD + _BSD_NAME.format(nth=3) + _BSD_TAIL),
    ("BSD-4-Clause text", _BSD_HEAD + _BSD_ADVERT + _BSD_NAME.format(nth=4) + _BSD_TAIL),
    (
        "0BSD text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        'hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT-0 text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE.",
    ),
    (
        "Zlib text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not "
        "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0 text",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any "
        "person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare '
        "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
        "subject to the following: The copyright notices in the Software and this entire statement, including the above "
        "license grant, this restriction and the following disclaimer, must be included in all copies of the Software, "
        "in whole or in part, and all derivative works of the Software, unless such copies or derivative works are "
        "solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
        "laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
        "present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, "
        "please refer to https://unlicense.org",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0 statement", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    (
        "MPL-2.0 notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "MPL-1.1 notice",
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use '
        "this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "
        '"AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific '
        "language governing rights and limitations under the License.",
    ),
    (
        "EPL-2.0 notice",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "BSL-1.0 notice",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)",
    ),
    ("MIT license line", "Licensed under the MIT License."),
    ("MIT work line", "This work is licensed under the MIT License."),
    ("Apache-2.0 release line", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0 work line", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
)


def _of_gnu():
    for family, name, versions in _GNU:
        for version in versions:
            spdx = f"{family}-{version if '.' in version else version + '.0'}"
            yield spdx, f"This work is licensed under the {name}, version {version}."
            yield f"{spdx} license line", f"Licensed under the {name}, version {version}."
            yield f"{spdx} release line", f"Released under the {name}, version {version}."
            yield f"{spdx} or later", f"This work is licensed under the {name}, version {version} or later."
            yield f"{spdx} notice", _GNU_NOTICE.format(name=name, version=version)
            yield f"{spdx} only notice", _GNU_ONLY.format(name=name, version=version)


def _of_cc():
    for short, name in _CC:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            spdx = f"CC-{short}-{version}"
            yield spdx, f"Licensed under CC {short} {version}."
            reach = "International" if version == "4.0" else "Unported" if version == "3.0" else "Generic"
            yield f"{spdx} name", f"This work is licensed under the Creative Commons {name} {version} {reach} License."


def _of_names():
    for spdx, name in _NAMED:
        yield spdx, f"Licensed under the {name}."
        yield f"{spdx} release line", f"Released under the {name}."
        yield f"{spdx} work line", f"This work is licensed under the {name}."


def _full():
    for path in sorted(_FOLDER.glob("*.txt")):
        yield f"{path.stem} full text", path.read_text(encoding="utf-8")


def common(first: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    """The templates ``first`` and all others whose names they do not have."""
    return tuple({**dict([*_SHORT, *_of_gnu(), *_of_cc(), *_of_names(), *_full()]), **dict(first)}.items())
