"""The licence scan names the closest of the versions and variants of a family."""

import pyarrow as pa
import pytest

from pulsefleet.llm import licenses

NAMES = dict(licenses.TEMPLATES)


def found(text):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST)
    return [scanner.names[hit[3]] for hit in scanner.scan(pa.array([text], pa.string()))]


@pytest.mark.parametrize(
    ("line", "name"),
    [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under the Mozilla Public License, Version 2.0.", "MPL-2.0"),
        ("Released under the BSD 3-Clause License.", "BSD-3-Clause release line"),
        ("Released under the MIT License.", "MIT"),
    ],
)
def test_lines_of_a_family(line, name):
    assert found(line) == [name]


def test_every_template_is_found_as_itself_or_an_equal_one():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST)
    for name, text in licenses.TEMPLATES:
        hits = [h for h in scanner.scan(pa.array([text.replace("\n", " ")], pa.string()))]
        assert len(hits) == 1 and hits[0][4] == 1.0, name


@pytest.mark.parametrize("spdx", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"])
def test_full_texts(spdx):
    text = NAMES[f"{spdx} full text"]
    assert len(text) > 5000 and f"{spdx} full text" in found("before\n\n" + text.replace("shall", "will", 5))
