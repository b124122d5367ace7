"""Each operator against brute force, and its defined results for nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lattica.llm import ann, arc, components, dedup, langid, mixing, ngram_join, packing, pii, quality, secrets, tokens

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use themselves.
EXTRA = "copy_no string, blob string, rule string, n_tokens string, bin string, size string, marks string, start string, total string, sig string, gram string, rate string, weight string, key string, id string, p string, host string"

CLASHES = ["__source", "__rate", "__copies", "___rate", "rate", "weight", "n_tokens", "__stratum", "__marks", "__cut_marks", "__rejected", "__id", "__gone", "__again", "__n", "__json0", "n"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)


def awkward(spark, with_extra=True):
    """Nulls in every column, empty and very long texts, repeated rows, a shared id."""
    long = " ".join(f"w{k % 977} é" for k in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"), (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"), (2, "The quick brown fox jumps over the lazy dog again and again!", "en", "b"),
        (3, "", "en", "a"), (4, None, "fr", "b"), (None, "mail bob@example.com please", "en", "a"), (5, "x", None, None), (6, long, "de", "b"), (7, "   \n\t ", "", ""), (7, "other text under one id", "en", "c"), (None, None, None, None), (8, long + " tail", "de", "b"),
    ]
    df = docs_of(spark, rows)
    if with_extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("kept").alias(x.split()[0]) for x in EXTRA.split(", ")])
    return df, rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def test_token_counts(spark):
    import regex

    ranks = tokens.load_ranks(tokens.TOKENIZER)
    whole = tokens.prove_whole(ranks)
    find = regex.compile(tokens.PRE_TOKENS).findall

    def brute(text):
        pieces = find(text or "")
        return sum(len(tokens.merge(p.encode(), ranks)) for p in pieces), len(pieces), sum(p in whole for p in pieces)

    df, rows = awkward(spark)
    got = Counter((r.doc_id, r.n_tokens, r.n_pretokens, r.n_direct, r.n_merged) for r in tokens.token_counts(df).collect())
    want = Counter()
    for i, t, *_ in rows:
        n, k, direct = brute(t)
        want[(i, n, k, direct, n - direct)] += 1
    assert got == want
    mixed = ["don't²½ Ⅷ x", "a_b__ c", "１２3 ٣", "naïve café — “q”", "   x\n\n\n y", "한국어 日本語 🙂🙂", "ǅ ʰ ª º"]
    got = tokens.token_counts(docs_of(spark, [(k, t, "en", "a") for k, t in enumerate(mixed)])).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_pretokens, r.n_direct) for r in got] == [brute(t) for t in mixed]
    assert tokens.token_counts(empty(spark)).count() == 0


def test_strings_that_merging_cannot_reach(spark, tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257, b"xyz": 258, b"yz": 259, b"ef": 260, b"efgh": 261, b"gh": 262}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    assert not {"abcd"} & tokens.prove_whole(ranks) and {"efgh", "xyz"} <= tokens.prove_whole(ranks)
    got = tokens.token_counts(docs_of(spark, [(1, "abcd", "en", "a"), (2, "efgh", "en", "a"), (3, "xyzabcd", "en", "a")]), str(path)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_direct) for r in got] == [(3, 0), (1, 1), (4, 0)]


def test_merge_is_the_definition():
    def slow(piece, ranks):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    draw = random.Random(3)
    for _ in range(300):
        made = [bytes(draw.choices(b"ab", k=draw.randint(2, 5))) for _ in range(8)]
        ranks = {b"a": 0, b"b": 1} | {m: k + 2 for k, m in enumerate(dict.fromkeys(made))}
        piece = bytes(draw.choices(b"ab", k=draw.randint(1, 30)))
        assert tokens.merge(piece, ranks) == slow(piece, ranks)


def test_whole_tokens_are_proven():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"a b": 259}
    whole = tokens.prove_whole(ranks)
    assert "ab" in whole and "abc" in whole
    assert "a b" not in whole  # two pre-tokens


# 2


def brute_two_fit(sizes, capacity):
    """Best-two-fit by its definition, with lists; ties as the operator breaks them."""
    left = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins = []
    while left:
        held, gap = [], capacity
        while True:
            fits = [i for i in left if sizes[i] <= gap]
            if not fits:
                break
            held.append(fits[0])
            left.remove(fits[0])
            gap -= sizes[fits[0]]
        if gap and len(held) > 1 and left:
            least = held[-1]
            room = gap + sizes[least]
            pairs = [(sizes[a] + sizes[b], max(sizes[a], sizes[b])) for a, b in combinations(left, 2) if sizes[least] < sizes[a] + sizes[b] <= room]
            if pairs:
                total, large = max(pairs)
                a = next(i for i in left if sizes[i] == large)
                left.remove(a)
                b = next(i for i in left if sizes[i] == total - large)
                left.remove(b)
                held[-1:] = [a, b]
                left = sorted([*left, least], key=lambda i: (-sizes[i], i))
        bins.append(held)
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_best_two_fit(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 20, 50])
    sizes = sorted((draw.randint(1, capacity) for _ in range(draw.randint(0, 40))), reverse=True)
    got, want = packing.best_two_fit(sizes, capacity), brute_two_fit(sizes, capacity)
    assert [[sizes[i] for i in b] for b in got] == [[sizes[i] for i in b] for b in want]
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in got)


def brute_pieces(text, capacity):
    """(text, tokens) of the parts of a text, by adding pre-tokens while they fit."""
    import regex

    ranks, known = tokens.load_ranks(tokens.TOKENIZER), {}

    def size(x):
        for p in (pre := regex.findall(tokens.PRE_TOKENS, x)):
            if p not in known:
                known[p] = len(tokens.merge(p.encode(), ranks))
        return sum(known[p] for p in pre)

    out, held, n = [], "", 0
    for p in regex.findall(tokens.PRE_TOKENS, text or ""):
        if size(p) > capacity:
            out += [held] * bool(held) + [p[k : k + capacity // 4] for k in range(0, len(p), capacity // 4)]
            held, n = "", 0
        elif held and n + size(p) > capacity:
            out.append(held)
            held, n = p, size(p)
        else:
            held, n = held + p, n + size(p)
    return [(x, size(x)) for x in [*out, held] if x]


def packed_again(got, capacity):
    """The sizes in each bin, in order, of each shard; and the same by brute force from the shard's pieces."""
    shards = {}
    for r in got:
        shards.setdefault(r.bin >> 32, []).append(r)
    for rows in shards.values():
        rows.sort(key=lambda r: (r.bin, r.slot))
        bins = {}
        for r in rows:
            bins.setdefault(r.bin, []).append((r.doc_id, r.row_id, r.piece, r.size))
        order = sorted(rows, key=lambda r: (-r.size, r.doc_id is not None, r.doc_id or 0, r.row_id, r.piece))
        want = brute_two_fit([r.size for r in order], capacity)
        yield [[x[3] for x in b] for b in bins.values()], [[order[i].size for i in b] for b in want]


@pytest.mark.parametrize("shard", [packing.SHARD, 2000])
def test_packing_brute(spark, shard):
    df, rows = awkward(spark)
    rows = [(i, t if t is None or len(t) < 1000 else t[:3000] + "b" * 700 + " é😀 end", lang, src) for i, t, lang, src in rows]
    rows += [(100 + k, f"some words {k} " * (k % 9), "en", "a") for k in range(60)]
    got = packing.best_fit_packing(docs_of(spark, rows), capacity=64, shard=shard).collect()
    held = {}
    for r in sorted(got, key=lambda r: r.piece):
        held.setdefault((r.doc_id, r.row_id), []).append(r)
    assert Counter((i, "".join(r.text for r in x)) for (i, _), x in held.items()) == Counter((i, t) for i, t, *_ in rows if t)
    want = Counter()
    for i, t, *_ in rows:
        at = 0
        for k, (x, n) in enumerate(brute_pieces(t, 64)):
            want[(i, k, at, n, x)] += 1
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.size, r.text) for r in got) == want
    for found, again in packed_again(got, 64):
        assert found == again and max(map(sum, found)) <= 64
    assert (len({r.bin >> 32 for r in got}) > 1) == (shard == 2000)
    assert packing.best_fit_packing(empty(spark)).count() == 0
    clash = docs_of(spark, rows[:3]).selectExpr("*", "1 AS shard", "2 AS bin", "3 AS row_id", "map('a', 1) AS size")
    assert packing.best_fit_packing(clash).count() == 3


# 3


def brute_pairs(rows, n=3, threshold=0.5):
    import re

    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        if i is None or not w:
            continue
        grams = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or frozenset([tuple(w)])
        sets.setdefault(grams, set()).add(i)
    out = {}
    for members in sets.values():
        for m in members - {min(members)}:
            out[(min(members), m)] = 1.0
    for a, b in combinations(sets, 2):
        j = len(a & b) / len(a | b)
        x, y = sorted((min(sets[a]), min(sets[b])))
        if j >= threshold - 1e-9 and x != y:
            out[(x, y)] = max(j, out.get((x, y), 0))
    return {k: round(v, 9) for k, v in out.items()}


def got_pairs(df, **options):
    return {(r.doc_a, r.doc_b): round(r.jaccard, 9) for r in ngram_join.similar_pairs(df, **options).collect()}


def brute_classes(rows, n=3, threshold=0.5):
    """doc_id, class_id, group_id, n_links by the definition, where no id is repeated."""
    pairs = brute_pairs(rows, n, threshold)
    same = brute_pairs(rows, n, 1.0)
    head = {b: a for a, b in same}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    links = Counter(x for p in set(pairs) - set(same) for x in p)
    return Counter((x, head.get(x, x), find(x), links[head.get(x, x)]) for x in list(root))


def got_classes(df, **options):
    found = ngram_join.ngram_jaccard_join(df, **options)
    assert found.columns == ["doc_id", "class_id", "group_id", "n_links"]
    return Counter(tuple(r) for r in found.collect())


def test_ngram_join_awkward(spark):
    df, rows = awkward(spark)
    assert got_pairs(df) == brute_pairs(rows)
    assert got_classes(df) == {(1, 1, 1, 0): 1, (2, 1, 1, 0): 1, (6, 6, 6, 1): 1, (8, 8, 6, 1): 1} == brute_classes(rows)
    assert ngram_join.ngram_jaccard_join(empty(spark)).count() == 0


@pytest.mark.parametrize("threshold,parts,small", [(0.5, 4, False), (0.8, 1, False), (0.4, 3, True)])
def test_ngram_join_brute(spark, threshold, parts, small, monkeypatch):
    if small:  # many fragments, and groups dealt to several tasks
        monkeypatch.setattr(ngram_join, "FRAGMENT", 3000)
        monkeypatch.setattr(ngram_join, "PAIRS", 200)
        monkeypatch.setattr(ngram_join, "DENSE", 1)
    draw = random.Random(3)
    base = [[f"t{draw.randint(0, 60)}" for _ in range(draw.randint(1, 60))] for _ in range(60)]
    rows = []
    for k in range(240):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 6])):
            words[draw.randrange(len(words))] = f"t{draw.randint(0, 60)}"
        rows.append((k, " ".join(words), "en", "a"))
    if parts == 1:
        assert got_pairs(docs_of(spark, rows), threshold=threshold, parts=parts) == brute_pairs(rows, threshold=threshold)
    assert got_classes(docs_of(spark, rows), threshold=threshold, parts=parts) == brute_classes(rows, threshold=threshold)


def test_overlaps_by_matrix_product():
    draw = np.random.default_rng(5)
    postings = np.sort(draw.integers(0, 5000, 20_000))
    local = draw.integers(0, 60, 20_000)
    both = np.unique(np.stack([postings, local], 1), axis=0)
    postings, local = both[:, 0], both[:, 1]
    held = {x: set(postings[local == x]) for x in range(60)}
    rows, cols = np.array([1, 5, 30]), np.arange(10, 60)
    got = ngram_join._products(local, postings, rows, cols)
    assert (got == [[len(held[a] & held[b]) for b in cols] for a in rows]).all()


# 4


def test_secret_ledger_is_incremental(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    key, token = "AKIA" + "ABCDEFGH23456789", "ghp_" + "a1B2c3D4e5F6g7H8i9J0" * 2
    text = f"é x {key} y"
    versions = spark.createDataFrame([("a", text), ("b", text), ("b", text), ("c", "nothing"), ("d", None), ("e", ""), (None, f'password = "{token}"')], "path string, text string")
    two = secrets.RULES[:2]
    assert secrets.scan_versions(versions, ledger, two) == 4  # four distinct texts
    assert secrets.scan_versions(versions, ledger, two) == 0
    found = secrets.secret_findings(versions, ledger, two, "path").collect()
    assert Counter((r.path, r.rule) for r in found) == {("a", "aws_access_key"): 1, ("b", "aws_access_key"): 2, (None, "github_token"): 1}
    assert all(text[r.start : r.end] == key for r in found if r.rule == "aws_access_key")
    assert all(r.secret_hash == hashlib.sha256(key.encode()).hexdigest() and key not in r.redacted for r in found if r.rule == "aws_access_key")
    more = versions.union(spark.createDataFrame([("f", f"new {key}")], "path string, text string"))
    assert secrets.scan_versions(more, ledger, two) == 1
    newer = (secrets.Rule("aws_access_key", 2, two[0].pattern, two[0].words), two[1])
    assert secrets.scan_versions(more, ledger, newer) == 5  # every blob, for the new version only
    entries = spark.read.parquet(f"{ledger}/ledger").selectExpr("blob", "explode(rules) AS rule")
    assert entries.count() == entries.distinct().count() == 15
    assert {r.rule_version for r in secrets.secret_findings(more, ledger, newer, "path").collect() if r.rule == "aws_access_key"} == {2}


def test_secrets_brute(spark):
    import re

    df, _ = awkward(spark)
    assert secrets.secret_findings(df).count() == 0
    assert secrets.secret_findings(empty(spark)).count() == 0
    draw = random.Random(1)
    made = ["AKIA" + "".join(draw.choices("ABCDEFGHJK234567", k=16)), "xoxb-1234567890-abcdefghij", 'api_key = "k3J9sd8fK2lq0PzX71"', "https://u:hunter22@example.com/x", "sk_live_" + "aB3dE5gH7jK9mN1p", "-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=0123456789abcdef\n-----END RSA PRIVATE KEY-----", "secret = aaaaaaaaaaaaaaaa", "plain words only"]
    rows = [(k, " ".join(["filler é " * draw.randint(0, 400), draw.choice(made), "end", draw.choice(made)]), "en", "a") for k in range(60)]
    rows += [(100 + k, rows[k][1], "en", "b") for k in range(10)]
    want = Counter()
    for i, t, *_ in rows:
        for rule in secrets.RULES:
            for m in re.finditer(rule.pattern, t):
                if secrets.entropy(m[1]) >= rule.entropy:
                    want[(i, rule.name, m.start(1), m.end(1))] += 1
    assert Counter((r.doc_id, r.rule, r.start, r.end) for r in secrets.secret_findings(docs_of(spark, rows)).collect()) == want
    assert len({k[1] for k in want}) >= 6


@pytest.mark.parametrize("text,rule,secret", [
    ("-----BEGIN RSA PRIVATE KEY-----\n" + "MIIabc+/=\n" * 12_000 + "-----END RSA PRIVATE KEY-----", "private_key", "\n" + "MIIabc+/=\n" * 12_000), ('password = "' + "aB3$xY7!" * 700 + '"', "assigned_secret", "aB3$xY7!" * 700),
    ("x eyJ" + "aA1_" * 3000 + ".eyJ" + "bB2-" * 4000 + "." + "cC3x" * 1000 + " y", "json_web_token", "eyJ" + "aA1_" * 3000 + ".eyJ" + "bB2-" * 4000 + "." + "cC3x" * 1000), ("xoxb-" + "1a2b" * 100, "slack_token", "xoxb-" + "1a2b" * 100),
    ("ghp_" + "a1B2" * 100, "github_token", "ghp_" + "a1B2" * 100), ("sk_live_" + "a1B2" * 100, "payment_key", "sk_live_" + "a1B2" * 100), ("https://u:" + "p4ss" * 100 + "@example.com", "url_password", "p4ss" * 100),
])
def test_long_secrets_are_whole(text, rule, secret):
    scanner = secrets._Scanner(secrets.RULES)
    assert [(start, x) for r, start, _, x in scanner("é " + text, {r.key for r in secrets.RULES}) if r.name == rule] == [(2 + text.index(secret), secret)]


@pytest.mark.parametrize("unit", ["-----BEGIN RSA PRIVATE KEY-----\n", "eyJaaaaaaaaa.", "token_", "://a:bbb", "a-a-", "xoxb-", "key = "])
def test_scan_time_grows_with_the_text(unit):
    import time

    scanner, keys = secrets._Scanner(secrets.RULES), {r.key for r in secrets.RULES}

    def taken(size):
        began = time.process_time()
        list(scanner(unit * (size // len(unit)), keys))
        return time.process_time() - began

    assert taken(400_000) < 10 * taken(100_000) + 0.5


# 5


PLANTED = [
    ("bob.smith@example.com", "email", "bob.smith@example.com"), ("bob [at] example [dot] com", "email", "bob@example.com"), ("bob (at) mail (dot) example (dot) org", "email", "bob@mail.example.org"), ("bob at example dot com", "email", "bob@example.com"),
    ("jоhn@exаmple.com", "email", "john@example.com"), ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "john@example.com"), ("jo​hn@exam­ple.com", "email", "john@example.com"), ("bob @ example.com", "email", "bob@example.com"),
    ("+1 (988) 555-2485", "phone", "+1 (988) 555-2485"), ("555-123-4567", "phone", "555-123-4567"), ("+49 30 1234567", "phone", "+49 30 1234567"), ("five five five, one two three four five six seven", "phone", "5551234567"), ("fünf fünf fünf eins zwei drei vier fünf sechs sieben", "phone", "5551234567"), ("double five five 1 2 3 4 5 6 7", "phone", "5551234567"),
    ("٥٥٥-١٢٣-٤٥٦٧", "phone", "555-123-4567"), ("42.144.35.254", "ip", "42.144.35.254"), ("4041894974608795", "card", "4041894974608795"), ("4041 8949 7460 8795", "card", "4041 8949 7460 8795"), ("DE89 3704 0044 0532 0130 00", "iban", "DE89 3704 0044 0532 0130 00"), ("078-05-1120", "ssn", "078-05-1120"),
]
CLEAN = ["at the end of and at the dot of it", "one two three and four men", "version 1.2.3.4.5 of 2024-01-02", "4041894974608796 isn't a card", "un deux trois", "999.1.1.1", "é — “quoted” … naïve", "a @ b", "12345678901"]


def test_pii_planted(spark):
    rows = []
    for k, (shown, _, _) in enumerate(PLANTED):
        rows.append((k, f"é Zeile {k}: see {shown}, thanks — ende", "en", "a"))
    rows += [(1000 + k, t, "en", "a") for k, t in enumerate(CLEAN)]
    found = pii.pii_spans(docs_of(spark, rows)).collect()
    text = {r[0]: r[1] for r in rows}
    got = {(r.doc_id, r.kind, r.source, r.value) for r in found}
    assert got == {(k, kind, shown, value) for k, (shown, kind, value) in enumerate(PLANTED)}
    assert all(text[r.doc_id][r.start : r.end] == r.source for r in found)
    masked = {r.doc_id: r for r in pii.mask_pii(docs_of(spark, rows)).collect()}
    for k, (shown, kind, _) in enumerate(PLANTED):
        assert masked[k].text == text[k].replace(shown, f"<{kind.upper()}>") and masked[k].n_chars == len(masked[k].text)
    assert all(masked[1000 + k].text == t for k, t in enumerate(CLEAN))


def test_pii_awkward(spark):
    df, rows = awkward(spark)
    assert [(r.doc_id, r.kind) for r in pii.pii_spans(df).collect()] == [(None, "email")]
    out = pii.mask_pii(df)
    assert out.columns == df.columns and out.schema == df.schema
    assert Counter(r.text for r in out.collect()) == Counter(t if t is None else t.replace("bob@example.com", "<EMAIL>") for _, t, *_ in rows)
    assert pii.pii_spans(empty(spark)).count() == pii.mask_pii(empty(spark)).count() == 0


def test_pii_prefilter_drops_nothing():
    import pyarrow as pa

    draw = random.Random(9)
    texts = ["".join(draw.choice(["five ", "two-", "at ", " dot ", "com", "@", "1", "é", "о", "[at]", "(dot)", "bob", " ", ".", "drei "]) for _ in range(12)) for _ in range(3000)]
    for text, may in zip(texts, pii.may_hold(pa.array(texts)), strict=True):
        for kind, start, end, source, _ in pii.find(text):
            assert may and text[start:end] == source, (text, kind)


def test_offsets_map_back():
    draw = random.Random(4)
    for _ in range(500):
        text = "".join(draw.choice("abcо９​­.") for _ in range(draw.randint(1, 30)))
        folded = pii.fold(text)
        if not folded:
            continue
        kept = [(k, c) for k, c in enumerate(text) if pii.FOLD.get(c, c)]
        assert folded.text == "".join(pii.FOLD.get(c, c) for _, c in kept)
        for i, (k, _) in enumerate(kept):
            assert folded.back(i, i + 1) == (k, k + 1)


# 6


def brute_mix(rows, weights, default, budget):
    import tiktoken

    encode = tiktoken.Encoding("brute", pat_str=tokens.PRE_TOKENS, mergeable_ranks=tokens.load_ranks(tokens.TOKENIZER), special_tokens={}).encode_ordinary
    n = lambda t: len(encode(t or ""))
    per = Counter()
    for _, t, _, s in rows:
        per[s] += n(t)
    weight = {s: (weights.get(s, default) if c else 0.0) for s, c in per.items()}
    whole, total = sum(weight.values()), sum(per.values())
    out = Counter()
    for i, _, _, s in rows:
        rate = weight[s] * budget * total / whole / per[s] if per[s] and whole else (0.0 if per[s] else 1.0)
        draw = int(hashlib.md5(f"mix|{'' if i is None else i}|{s or ''}".encode()).hexdigest()[:8], 16) / 2**32
        for c in range(int(rate) + (draw < rate - int(rate))):
            out[(i, s, c)] += 1
    return out


@pytest.mark.parametrize("weights,default,budget", [({}, 1.0, 1.0), ({"a": 3.0, "b": 0.0}, 0.5, 2.5)])
def test_mixing(spark, weights, default, budget):
    df, rows = awkward(spark)
    rows = rows + [(50 + k, "some words in here " * (k % 7), "en", "abc"[k % 3]) for k in range(200)]
    from pyspark.sql import functions as F

    df = docs_of(spark, rows).withColumns({c: F.lit(1) for c in CLASHES}).withColumn("copy_no", F.lit("x")).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = Counter((r.doc_id, r.source, r.copy_no) for r in mixing.mix_sources(df, weights, default, budget).collect())
    assert got == brute_mix(rows, weights, default, budget)
    row = mixing.mix_sources(df, weights, default, budget).first()
    assert all(row[c] == 1 for c in CLASHES) and row.m == {"a": 1}
    assert mixing.mix_sources(empty(spark)).count() == 0


# 7


def test_quality_risk_is_controlled(spark):
    draw = random.Random(2)
    rows, labels = [], []
    for k in range(3000):
        good = draw.random() < 0.8
        words = ["word" + str(draw.randint(0, 500)) for _ in range(40)]
        if not good:
            words = [w + "#$%&!" if draw.random() < 0.6 else w for w in words]
        elif draw.random() < 0.004:
            words = [w + "#" for w in words]
        rows.append((k, " ".join(words), draw.choice(["en", "de"]), "a"))
        labels.append((k, int(good)))
    table = spark.createDataFrame([*labels, (None, 1), (10**9, 0), (5, None)], "doc_id bigint, quality int")
    kept = {r.doc_id for r in quality.quality_filter(docs_of(spark, rows), table).collect()}
    good = {k for k, g in labels if g}
    assert len(good - kept) <= quality.ALPHA * len(good)
    assert len(kept - good) < 0.1 * (3000 - len(good))


def test_binomial_tail():
    from math import comb

    for n, p in ((1, 0.3), (20, 0.05), (60, 0.5)):
        for k in range(n + 1):
            exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(quality.tail(k, n, p) - exact) < 1e-12
    assert quality.choose_cutoff([0] * 15, [5] * 15, 10, 10, 0.05, 0.05) is None  # ten documents certify nothing


def brute_values(text):
    """The rules by their definition, in the order of RULES."""
    import re

    text = text or ""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(r"[^\t\n\f\r ]+", low)
    lines = [tuple(x) for x in (re.findall(r"[^\t\f\r ]+", y) for y in low.split("\n")) if x]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    per = lambda x, of: 1000 * x // max(of, 1)
    repeats = max(per(sum(x == y for x, y in zip(w, w[1:], strict=False)), len(w)), per(len(lines) - len(set(lines)), len(lines)), per(len(grams) - len(set(grams)), len(grams)))
    bare = max(0, 1000 - 10 * per(sum(x in quality.STOP_WORDS for x in w), len(w))) if len(w) >= 20 else 0
    strange = max(bare, per(sum(len(x) > 20 for x in w), len(w)), per(sum(not re.search("[a-z\x80-\U0010ffff]", x) for x in w), len(w)))
    return per(sum(c in "#$%&*|!" for c in text), len(w)), per(sum("A" <= c <= "Z" for c in text), len(text)), repeats, strange


def test_rule_values_brute(monkeypatch):
    draw = random.Random(4)
    pieces = ["the ", "The\n", "é—x ", "A#! ", "a a a ", "\n\n", "\t", "word " * 3, "x" * 25 + " ", "12 ", "una línea\n", "\r\n", "\f", "\xa0", "🙂 "]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 60))) for _ in range(300)] + [None, "", " ", "\n", "x", "The the", "a b c a b c"]
    want = [brute_values(t) for t in texts]
    data = [None if t is None else t.encode() for t in texts]
    assert [tuple(map(int, r)) for r in quality.rule_values(data)] == want
    monkeypatch.setattr(quality, "LONG_TEXT", 40)  # texts longer than this are taken in parts
    assert [tuple(map(int, r)) for r in quality.rule_values(data)] == want


def test_quality_awkward(spark):
    from pyspark.sql import functions as F

    df, rows = awkward(spark)
    df = df.withColumns({c: F.lit(1) for c in CLASHES if c not in df.columns}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    out = quality.quality_filter(df, labels)
    assert out.columns == df.columns and out.count() == len(rows)  # too few labels to reject anything
    assert quality.quality_filter(df, labels.limit(0)).count() == len(rows)
    assert quality.quality_filter(empty(spark), labels).count() == 0
    got = Counter((r.doc_id, r.marks, r.capitals, r.repeats, r.strange) for r in quality.quality_scores(df, labels).collect())
    assert got == Counter((i, *brute_values(t)) for i, t, *_ in rows)


@pytest.mark.parametrize("labels_sent", [quality.LABELS, 0])
def test_repeated_texts_have_one_vote(spark, labels_sent, monkeypatch):
    monkeypatch.setattr(quality, "LABELS", labels_sent)
    good = [(k, f"the text number {k} of the good ones", "en", "a") for k in range(100)]
    bad = [(1000 + k, f"w{k}## " * 8, "en", "a") for k in range(50)]
    labels = [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad]
    again = good * 10 + [(5000 + 100 * k + i, t, lang, s) for k in range(10) for i, t, lang, s in good] + bad
    labels += [(5000 + 100 * k + i, 1, 0) for k in range(10) for i, *_ in good] + labels
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert [tuple(r) for r in quality.cutoffs(docs_of(spark, good + bad), table).collect()] == [("en", None, None, None, None)]
    assert [tuple(r) for r in quality.cutoffs(docs_of(spark, again), table).collect()] == [("en", None, None, None, None)]
    assert quality.quality_filter(docs_of(spark, again), table).count() == len(again)


# 8


def exact_neighbours(v, ids, k):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = (unit @ unit.T).round(9)
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-sims[i, j], ids[j]))
        out[ids[i]] = [(ids[j], sims[i, j]) for j in order[:k]]
    return out


def test_ann_recall_on_random_directions(spark):
    v = np.random.default_rng(0).normal(size=(600, 32))
    df = spark.createDataFrame([(k, x.tolist(), "x", 1.0) for k, x in enumerate(v)], "vec_id bigint, embedding array<float>, id string, cosine double")
    want = exact_neighbours(v.astype(np.float32).astype(np.float64), list(range(600)), 10)
    got = {}
    for r in ann.nearest_neighbours(df).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
    hits = sum(len(got.get(i, set()) & {j for j, _ in near}) for i, near in want.items())
    assert hits / 6000 >= 0.9
    assert max(map(len, got.values())) == 10


def test_ann_pigeonhole_finds_every_code_in_the_radius(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 32))
    v = (centres[draw.integers(0, 40, 700)] + 0.15 * draw.normal(size=(700, 32))).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    radius = 5
    assert ann.plan(700, 32, radius, 8)[0] > 1  # several substrings
    rows, dims = ann.unit_vectors(df, "vec_id", "embedding")
    w = ann.learn_rotation(rows.cache(), dims, 32)
    unit = (v / np.sqrt((v.astype(np.float64) ** 2).sum(axis=1, keepdims=True))).astype(np.float32)
    codes = ann.encode(unit, w)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius
    want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i != j}
    got = {(r.vec_id, r.neighbour) for r in ann.nearest_neighbours(df, k=700, radius=radius, unit=8).collect()}
    assert len(got ^ want) <= 0.002 * len(want)  # a sign may fall either way at 0


def test_ann_queries_are_the_ids_divisible_by(spark):
    draw = np.random.default_rng(3)
    v = np.concatenate([draw.normal(size=(200, 16)), np.repeat(draw.normal(size=(1, 16)), 30, axis=0)]).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(7, x.tolist()) for x in draw.normal(size=(25, 16))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole, some = (ann.nearest_neighbours(df, k=5, every=e, radius=16).collect() for e in (1, 10))
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in whole if r.vec_id % 10 == 0)
    by = Counter(r.vec_id for r in whole)
    assert set(by.values()) == {5} and len(by) == 230


@pytest.mark.parametrize("n,bits,radius,unit", [(10**4, 64, 3, 100), (10**6, 64, 28, 8000), (10**9, 64, 6, 8000), (500, 16, 16, 10), (5, 8, 0, 8000)])
def test_pigeonhole_cover(n, bits, radius, unit):
    m, first, each = ann.plan(n, bits, radius, unit)
    assert len(each) == m and sum(r + 1 for r in each) >= radius + 1  # else a code could be over the limit everywhere
    draw = random.Random(n)
    for _ in range(300):
        flipped = draw.sample(range(bits), min(bits, radius))
        width = bits // m
        assert any(sum(j * width <= b < (j + 1) * width for b in flipped) <= each[j] for j in range(m))


def test_ann_awkward(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [float("nan"), 1.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, k=2, radius=2).orderBy("vec_id", "neighbour").collect():
        got.setdefault(r.vec_id, []).append((r.neighbour, r.cosine))
    assert got == {1: [(2, 1.0), (9, 1.0)], 2: [(1, 1.0), (9, 1.0)], 3: [(1, 0.0), (2, 0.0)], 9: [(1, 1.0), (2, 1.0)]}
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


# 9


ARC_ROWS = [
    ("http://example.org/a b", "192.0.2.1", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<html>\n\nhttp://x 1.2.3.4 hello</html>"), ("dns:example.org", "192.0.2.1", "20010203040507", "text/dns", b"20010203\nexample.org. 1 IN A 192.0.2.1"),
    ("http://example.org/empty", "0.0.0.0", "2001020304", "text/plain", b""), ("ftp://example.org/é", "::1", "20010203040506123", "application/x-\xff".encode("latin1").decode("latin1"), bytes(range(256))), ("http://example.org/a b", "192.0.2.1", "20010203040506", "text/html", b"HTTP/1.0 404 No\n\nx"),
]


def parse_warc(data):
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.0"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        out.append((fields, rest[:n]))
        assert rest[n : n + 4] == b"\r\n\r\n"
        data = rest[n + 4 :]
    return out


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_arc_round_trip(spark, version, packed):
    import gzip

    data = arc.arc_bytes("n.arc", ARC_ROWS, version)
    if packed:
        cut = data.find(b"\ndns:") + 1
        data = gzip.compress(data[:cut]) + gzip.compress(data[cut:])
    df = spark.createDataFrame([("n.arc", bytearray(data), "x"), ("n.arc", bytearray(data), "x"), (None, None, None), ("e", bytearray(b""), "x")], "path string, content binary, record string")
    rows = arc.convert_arcs(df).orderBy("offset").collect()
    assert len(rows) == 12 and {r.problem for r in rows} == {None} and {r.arc_version for r in rows[2:]} == {version}
    rows = rows[::2]
    assert [r.warc_type for r in rows] == ["warcinfo", "response", "response", "resource", "resource", "response"]
    records = parse_warc(b"".join(bytes(r.record) for r in rows))
    assert [b for _, b in records[1:]] == [x[4] for x in ARC_ROWS]
    assert [r.target_uri for r in rows[1:]] == [x[0] for x in ARC_ROWS]
    assert rows[1].warc_date == "2001-02-03T04:05:06Z" and rows[3].warc_date == "2001-02-03T04:00:00Z"
    body = ARC_ROWS[0][4].partition(b"\r\n\r\n")[2]
    import base64

    assert rows[1].payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode() == records[1][0]["WARC-Payload-Digest"]
    assert len({r.record_id for r in rows}) == 6
    assert arc.convert_arcs(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_damage(version):
    data = arc.arc_bytes("n.arc", ARC_ROWS, version)
    n = len(ARC_ROWS[0][4])
    for wrong, problem in ((n - 5, "longer than declared"), (n + 5, None), (n + 10**6, "shorter than declared")):
        records = list(arc.parse_arc(data.replace(f" {n}\n".encode(), f" {wrong}\n".encode(), 1)))
        if problem:
            assert (records[1].problem, records[1].block) == (problem, ARC_ROWS[0][4])
            assert [r.block for r in records[2:]] == [x[4] for x in ARC_ROWS[1:]]
        else:
            assert records[1].problem == "longer than declared" and [r.block for r in records[-3:]] == [x[4] for x in ARC_ROWS[2:]]
    cut = list(arc.parse_arc(data[: data.find(b"IN A")]))
    assert cut[-1].problem == "shorter than declared"
    junk = list(arc.parse_arc(b"\x00garbage\n" + data))
    assert junk[0].problem == "no header line" and [r.block for r in junk[2:]] == [x[4] for x in ARC_ROWS]
    assert list(arc.parse_arc(b"")) == []


def test_arc_gzip_resynchronises():
    import gzip

    data = arc.arc_bytes("n.arc", ARC_ROWS, 1)
    cuts = [0, *[m.start() + 1 for m in __import__("re").finditer(rb"\n(?=dns:|http://example.org/empty|ftp:)", data)], len(data)]
    members = [gzip.compress(data[a:b]) for a, b in zip(cuts, cuts[1:])]
    bad = bytearray(members[1])
    bad[len(bad) // 2 : len(bad) // 2 + 6] = b"\xff" * 6
    text, problem = arc.unpacked(members[0] + bytes(bad) + b"".join(members[2:]))
    assert problem == "damaged gzip member"
    blocks = [r.block for r in arc.parse_arc(text)]
    assert ARC_ROWS[0][4] in blocks and ARC_ROWS[2][4] in blocks and ARC_ROWS[3][4] in blocks
    text, problem = arc.unpacked(b"".join(members) + b"trailing")
    assert text == data and problem == "damaged gzip member"
    assert arc.unpacked(b"".join(members)[:-9])[1] == "cut gzip member"


@pytest.mark.parametrize("value,date", [("20010231120000", None), ("20000229000000", "2000-02-29T00:00:00Z"), ("20010229000000", None), ("20011301000000", None), ("20010101240000", None), ("2001", None)])
def test_arc_dates(value, date):
    assert arc._date(value) == date


def test_archives_do_not_depend_on_partitions(spark):
    pages = spark.range(60).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat('x', 200) AS html")
    got = [sorted((r.path, bytes(r.content)) for r in arc.archives_of_pages(pages.repartition(n), size).collect()) for n, size in ((1, 5000), (5, 5000))]
    assert got[0] == got[1] and len(got[0]) == 4
    assert {r.arc_version for r in arc.convert_arcs(arc.archives_of_pages(pages)).collect()} == {1, 2}


def test_pages_to_archives(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, None, "x"), (3, "http://b/", None), (None, "http://c/", ""), (1, "http://a/", "<p>é</p>")], "page_id bigint, url string, html string")
    rows = arc.convert_arcs(arc.archives_of_pages(pages)).collect()
    assert Counter(r.target_uri for r in rows if r.target_uri) == {"http://a/": 2, "http://c/": 1} and not any(r.problem for r in rows)


# 10


LANGS = {"en": "the and of to with that this house water", "de": "der und die das nicht mit haus wasser über", "fr": "le les des une dans avec maison eau être"}


def sentence(draw, lang, n=12):
    return " ".join(draw.choice(LANGS[lang].split()) for _ in range(n))


def test_language_accuracy_and_fusion(spark):
    draw = random.Random(6)
    docs, pages, truth = [], [], {}
    for k in range(600):
        lang = draw.choice(list(LANGS))
        docs.append((k, sentence(draw, lang), lang, f"s{k % 3}"))
    for k in range(300):
        lang = list(LANGS)[k % 3]
        truth[k] = lang
        said = lang if draw.random() < 0.9 else draw.choice(list(LANGS))
        pages.append((k, f"http://www.site{k % 3}.example.{lang}/{k}", f'<html lang="{said}-XX"><script>le les des une</script><body><p>{sentence(draw, lang, 8)}</p></body></html>'))
    pages.append((900, "http://www.site1.example.de/none", "<html><body></body></html>"))  # only its address speaks
    pages += [(901, None, None), (902, "not a url", "<html lang='fr'></html>"), (None, "http://x.de", ""), (901, None, None)]
    found = langid.language_id(docs_of(spark, docs), spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert len(found) == len(docs) + len(pages)
    by = {r.page_id: r for r in found if r.page_id is not None}
    assert sum(by[k].lang == lang for k, lang in truth.items()) / 300 > 0.98
    assert by[900].lang == "de" and by[900].suffix == "de" and by[900].text_lang is None
    assert by[902].lang == "fr" and by[902].declared == "fr"
    assert by[901].lang in LANGS
    assert all(0 < r.confidence <= 1 for r in found)
    held = {i: lang for i, _, lang, _ in docs}
    assert sum(r.lang == held[r.doc_id] for r in found if r.doc_id is not None) / 600 > 0.98


def test_text_evidence_brute():
    table = np.log(np.random.default_rng(0).random((3, langid.BUCKETS))).astype(np.float32)
    texts = [b"hello world", None, b"", b"x", b"abc" * 700_000, b"zz", "é".encode() * 10]
    got = langid.text_evidence(texts, table)
    for t, g in zip(texts, got, strict=True):
        data = np.frombuffer(b" " + (t or b"") + b" ", np.uint8)
        h = langid.trigrams(data) if len(data) > 2 else np.zeros(0, np.int64)
        s = table[:, h].sum(axis=1, dtype=np.float64) * langid.SHARE
        assert np.allclose(g, np.maximum(s - s.max(), -langid.LIMIT), atol=1e-3)


def test_language_training_brute(spark):
    docs = docs_of(spark, [(1, "abcd", "en", "a"), (2, "AB", "en", "a"), (3, "xyz", "DE", "b"), (4, None, "de", "b"), (5, "zzz", None, "b")])
    langs, table = langid.train(docs)
    assert langs == ["de", "en"]
    counts = np.zeros((2, langid.BUCKETS))
    for k, t in ((1, b" abcd "), (1, b" ab "), (0, b" xyz ")):
        np.add.at(counts[k], langid.trigrams(np.frombuffer(t, np.uint8)), 1)
    want = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * langid.BUCKETS))
    assert np.allclose(table, want, atol=1e-5)


def test_language_awkward(spark):
    df, rows = awkward(spark)
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert langid.language_id(df, pages).count() == len(rows)
    assert langid.language_id(empty(spark), pages).count() == 0
    one = spark.createDataFrame([(1, "http://a.de/", "<p>x</p>")], "page_id bigint, url string, html string")
    assert [(r.page_id, r.lang) for r in langid.language_id(empty(spark), one).collect()] == [(1, None)]


# groups


def test_groups_brute(spark):
    draw = random.Random(8)
    pairs = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(60)] + [(None, 1), (5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {x: find(x) for x in root if find(x) != x}
    got = components.groups(spark.createDataFrame(pairs, "doc_a bigint, doc_b bigint").repartition(5)).collect()
    assert {r.member: r.head for r in got} == want and len(got) == len(want)


def test_keep_one(spark):
    df, rows = awkward(spark)
    kept = dedup.keep_one(df, ngram_join.ngram_jaccard_join(df))
    assert kept.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    gone = {2, 8}
    assert got == Counter({(i, t) for i, t, *_ in rows if i not in gone})
    from pyspark.sql import functions as F

    again = docs_of(spark, [rows[0], rows[0], (9, "a", "en", "a"), (9, "a", "en", "a"), (9, "b", "en", "a"), (None, "n", "en", "a")]).withColumns({c: F.lit(1) for c in CLASHES}).withColumn("m", F.create_map(F.lit("a"), F.col("text")))
    kept = dedup.keep_one(again, spark.createDataFrame([(1, 1)], "doc_id bigint, group_id bigint"))
    assert kept.columns == again.columns
    assert Counter((r.doc_id, r.text, r.m["a"]) for r in kept.collect()) == Counter([(1, rows[0][1], rows[0][1]), (9, "a", "a"), (9, "b", "b"), (None, "n", "n")])
    assert dedup.keep_one(empty(spark), ngram_join.ngram_jaccard_join(empty(spark))).count() == 0


def test_mixing_by_words_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, "some words in here " * (k % 7), "en", "abc"[k % 3]) for k in range(200)]
    df = docs_of(spark, rows)
    df.write.parquet(str(tmp_path / "d"))
    got = mixing.mix_sources(df, size=packing.words(df.text)).collect()
    want = duckdb.sql(mixing.oracle_sql(f"read_parquet('{tmp_path}/d/*.parquet')")).fetchall()
    assert Counter(tuple(r) for r in got) == Counter(want)
