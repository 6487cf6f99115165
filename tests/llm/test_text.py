"""Words by numpy against regular expressions."""

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import _text
from ridgeline.llm._text import ALNUM, SPACED, word_hash, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED_RE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aAbZ09 \t\n\x0b\r\x1c.,-_éßñ漢\U0001f600")), max_size=60)), max_size=8)


def found(texts, table):
    out = []
    for first, last, bounds, h, starts, ends, part in words(pa.array(texts, pa.string()), table):
        for k in range(last - first):
            own = range(bounds[k], bounds[k + 1])
            out.append([(bytes(part[starts[i] : ends[i]]).decode().translate(LOWER), int(h[i])) for i in own])
    return out


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_expressions(texts):
    names = {}
    for table, pattern in ((SPACED, SPACED_RE), (ALNUM, ALNUM_RE)):
        got = found(texts, table)
        assert [[w for w, _ in row] for row in got] == [pattern.findall((t or "").translate(LOWER)) for t in texts]
        for row in got:
            for w, h in row:
                assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"word{k}" for k in range(5000)) + " " + "x" * 5000 + " end"
    whole = word_hash(text, SPACED).tolist()
    monkeypatch.setattr(_text, "PIECE", 512)
    assert word_hash(text, SPACED).tolist() == whole and len(whole) == 5002
    sliced = pa.array(["skip", text, None, "tail"], pa.string()).slice(1)
    assert [len(r) for r in found(sliced.to_pylist(), SPACED)] == [5002, 0, 1]
