"""Licences that differ in a word: each has its own label, unknown ones have none."""

import pytest

from hearthline.llm import licences as L

GPL = next(t for x, t in L.TEMPLATES if x == "gpl-3" and len(t.split()) > 30)
BSD = next(t for x, t in L.TEMPLATES if x == "bsd-3-clause")
MIT = next(t for x, t in L.TEMPLATES if x == "mit" and len(t.split()) > 30)
APACHE = next(t for x, t in L.TEMPLATES if x == "apache-2" and len(t.split()) > 30)
CASES = [
    ("licensed under the GNU General Public License, version 2", {"gpl-2"}),
    ("licensed under the GNU General Public License, version 4", set()),
    ("licensed under the GNU Affero General Public License, version 3", {"agpl-3"}),
    ("licensed under a Creative Commons Attribution 4.0 International License", {"cc-by"}),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa"}),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", {"cc-by-nc"}),
    ("licensed under a Creative Commons Attribution-ShareAlike 3.0 International License", set()),
    ("Licensed under the Apache License, Version 1.1", {"apache-1.1"}),
    ("Licensed under the Apache License, Version 1.0", set()),
    ("Licensed under the Apache License, Version 2.0", {"apache-2"}),
    (APACHE, {"apache-2"}),
    (APACHE.replace("Version 2.0", "Version 3.0").replace("LICENSE-2.0", "LICENSE-3.0"), set()),
    (GPL, {"gpl-3"}),
    (GPL.replace("either version 3", "either version 2"), {"gpl-2"}),
    (GPL.replace("either version 3", "either version 4"), set()),
    (GPL.replace("GNU General", "GNU Affero General"), {"agpl-3"}),
    (GPL.replace("GNU General", "GNU Lesser General"), {"lgpl-3"}),
    (BSD, {"bsd-3-clause"}),
    (BSD[: BSD.index("Neither")], {"bsd-2-clause"}),
    (MIT, {"mit"}),
    (MIT[: MIT.index(", subject to")], set()),
]


@pytest.mark.parametrize("text, labels", CASES)
def test_siblings(text, labels):
    assert {x for _, _, x, _ in L.scanner().scan(f"before {text}. after")[2]} == labels


def test_several_in_one_text():
    text = " and ".join(t for t, _ in CASES[:2]) + " but " + GPL + " or " + BSD
    assert [x for _, _, x, _ in L.scanner().scan(text)[2]] == ["gpl-2", "gpl-3", "bsd-3-clause"]
