"""Cutting texts by the library's tokens: one call a text, and the parts that pre-tokens one by one would give."""

import random
import sys
import unicodedata

import regex
import tiktoken

from lattica.llm import tokens

RANKS = tokens.load_ranks(tokens.TOKENIZER)
WHOLE = tokens.prove_whole(RANKS)


def parts(text, capacity, ranks):
    """The parts by adding pre-tokens while they fit."""
    out, held, n = [], "", 0

    def size(x):
        return sum(len(tokens.merge(p.encode(), ranks)) for p in regex.findall(tokens.PRE_TOKENS, x))

    for p in regex.findall(tokens.PRE_TOKENS, text):
        k = len(tokens.merge(p.encode(), ranks))
        if held and n + k > capacity:
            out.append((held, n))
            held, n = "", 0
        if k > capacity:
            run = max(1, capacity // 4)
            out += [(p[i : i + run], size(p[i : i + run])) for i in range(0, len(p), run)]
        else:
            held, n = held + p, n + k
    return out + [(held, n)] * bool(held)


def test_one_call_a_text(monkeypatch):
    draw, calls, whole = random.Random(2), [], tiktoken.Encoding.encode_ordinary
    texts = [" ".join("".join(draw.choices("aeinrstlo", k=9)) for _ in range(400)) for _ in range(5)]
    want = [parts(t, 300, RANKS) for t in texts]
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: calls.append(text) or whole(self, text))
    tokens._STATE.clear()
    try:
        got = [list(tokens.cut_text(t, 300, tokens.TOKENIZER, WHOLE)) for t in texts]
    finally:
        tokens._STATE.clear()
    assert got == want and max(map(len, got)) > 1
    assert len(calls) == len(texts)  # once for each word that is no token before


def test_parts_are_those_of_the_definition():
    draw = random.Random(5)
    some = ["a", "Zx", " ", "  ", "\n", "\n\n", "\t", "　", "\xa0", "é", "½", "Ⅷ", "١", "😀", "한", "'s", "'", "...", "_", "\x1c", "\x1f", "2048", " the", "́", "q" * 30, " " * 9, "\r\n", "\x85", "ª"]
    for _ in range(3000):
        text, capacity = "".join(draw.choices(some, k=draw.randint(1, 60))), draw.choice([1, 2, 3, 8, 30])
        assert list(tokens.cut_text(text, capacity, tokens.TOKENIZER, WHOLE)) == parts(text, capacity, RANKS), (text, capacity)


def test_texts_not_encoded_at_once(tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    whole = tokens.prove_whole(ranks)
    assert list(tokens.cut_text("abcd ab", 9, str(path), whole)) == [("abcd ab", 5)]  # "abcd" is in the vocabulary, but merging ends at three tokens
    assert list(tokens.cut_text("abcd ab", 3, str(path), whole)) == parts("abcd ab", 3, ranks)
    long = ("x" + " " * 400_000) * 3 + "y"  # more than the library is given at once
    assert "".join(x for x, _ in tokens.cut_text(long, 2048, tokens.TOKENIZER, WHOLE)) == long


def test_engines_agree_on_assigned_characters():
    known = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Cs"))
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        engine = tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        assert bytes(engine.encode_ordinary(known)).decode() == "".join(regex.findall(kind, known))
