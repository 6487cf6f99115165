"""Words are cut before the tokenizer sees them, and their ids stay those of whole texts."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from ridgeline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_those_of_whole_texts():
    rng = random.Random(3)
    letters = "aAbZ sS'tT09,.!<|>_endoftxTéÉßΣσİ\u0301\u0307\t\n$-中…¿\x7f\x01\x1c "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["it's 'sun DON'T <|endoftext|>x I'M we're99,'s", "ABC<|ENDOFTEXT|>", "ΑΣ. ΑΣ.b", "", "ciónez.%%% eroutian&&& 2024-11-27"]
    texts += [f"{a}{chr(c)}b {chr(c)}{chr(c)} x{chr(c)}.{chr(c)}1" for c in [*range(1, 0xD7FF, 7), *range(0x80, 0x370)] for a in "aZ"]
    plain, ids = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    for first, flat, begins in packing.tokens(pa.array(texts), ids):
        for k in range(len(begins) - 1):
            assert flat[begins[k] : begins[k + 1]].tolist() == plain.encode(texts[first + k], add_special_tokens=False).ids + [2]


def test_words_that_differ_by_case_or_signs_are_met_once():
    ids = packing.WordIds(PATH)
    signs = ("", ".", ",", "!", "%%%", "&&&")
    list(packing.tokens(pa.array([" ".join(word + sign for word in ("river", "River", "RIVER") for sign in signs)]), ids))
    assert len(ids.hashes) == len(signs)


def test_other_tokenizers_get_whole_words(tmp_path):
    changed = Tokenizer.from_file(PATH)
    from tokenizers import normalizers

    changed.normalizer = normalizers.NFC()
    changed.save(str(tmp_path / "other.json"))
    ids = packing.WordIds(str(tmp_path / "other.json"))
    assert ids.classes is None
    flat = np.concatenate([flat for _, flat, _ in packing.tokens(pa.array(["River river. x2"]), ids)])
    assert flat.tolist() == changed.encode("River river. x2", add_special_tokens=False).ids + [2]
