import re
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwake.llm.words import document_of, normalise, windows, word_hashes


def words(text):
    return re.findall(r"[^\W_]+", normalise(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("ab -\n>0é", max_size=30)), max_size=6))
def test_hashes_stand_for_words(texts):
    hashes, ends = word_hashes(texts)
    want = [[w for w in words(t.replace("\0", " "))] if t else [] for t in texts]
    assert list(np.diff(np.concatenate([[0], ends]))) == [len(w) for w in want]
    names = {}
    for w, h in zip((w for ws in want for w in ws), hashes.tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_normal_forms():
    assert words("Ｆｕｌｌ ﬁne soft­hy​phen") == ["full", "fine", "softhyphen"]
    assert words("exam-\nple exam-\r\n> ple well-known 3.5 snake_case") == [
        "example", "example", "well", "known", "3", "5", "snake", "case"
    ]
    assert words("> a\n> > b «c» STRASSE straße") == ["a", "b", "c", "strasse", "strasse"]
    assert words(unicodedata.normalize("NFD", "Überflüge")) == words("überflüge")


def test_windows_and_owners():
    hashes, ends = word_hashes(["a b c", None, "a b c d"])
    assert list(document_of(ends)) == [0, 0, 0, 2, 2, 2, 2]
    w = windows(hashes, (0, 2))
    assert w[0] == w[3] and len(set(w.tolist())) == 4
    assert len(windows(hashes, (0, 50))) == 0
