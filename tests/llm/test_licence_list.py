from __future__ import annotations

import pytest

from callweave.llm import licences
from callweave.llm.licence_texts import BSD_CONDITIONS, BSD_DISCLAIMER, BSD_NAMES, FULL, TEMPLATES, full_text

MATCHER = licences.Matcher(TEMPLATES, 0.8)


def best(text):
    return max(MATCHER.hits(text), key=lambda h: h[4])[0]


@pytest.mark.parametrize("licence", FULL)
def test_whole_texts_are_known(licence):
    assert best(full_text(licence)) == licence


def test_bsd_texts_are_told_apart():
    start = "Copyright (c) 2020 Someone. All rights reserved.\n\n"
    assert best(f"{start}{BSD_CONDITIONS}\n\n{BSD_DISCLAIMER}") == "BSD-2-Clause"
    assert best(f"{start}{BSD_CONDITIONS}\n{BSD_NAMES}\n\n{BSD_DISCLAIMER}") == "BSD-3-Clause"


@pytest.mark.parametrize("licence", ["LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "EPL-2.0", "Zlib", "BSL-1.0"])
def test_headers_are_known(licence):
    notice = next(t for name, t in TEMPLATES if name == licence)
    assert licence in {h[0] for h in MATCHER.hits(f"/* code */\n\n{notice}\n\nint x;")}
