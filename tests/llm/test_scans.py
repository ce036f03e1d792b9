"""Operators that read each document alone, against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, langid, pii, rans, tokens

DOCS = "doc_id bigint, text string, lang string, source string, n_words string, hit string"
ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
TEXTS = [
    (0, f"Before. {ITEM.upper()}! after", "en", "a"), (1, None, None, None), (2, "", "fr", ""), (3, "short item here?", "en", "a"), (4, "nothing to see " * 40, "de", "b"),
    (5, "x" * 30_000 + " " + ITEM + " " + "y " * 20_000, "en", "a"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a"),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a"), (None, "Short, ITEM... here", "es", None), (7, "é" + ITEM, "fr", "c"), (8, "-- !! \n\t", "de", "b"),
]
BENCH = [(1, ITEM), (2, "short item here"), (3, None), (4, " ?!"), (1, ITEM), (None, "nothing to see"), (5, "gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, "clash", "clash") for t in TEXTS], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def plain_contamination(text, width=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, items = set(), set()
    for ident, item in BENCH:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").lower())
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    items |= {ident} - {None}
    return len(words), len(hit), sorted(items), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [1 << 20, 10])
def test_contamination(spark, docs, block):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    got = decontaminate.contamination(docs, bench, block_bytes=block).collect()
    want = sorted(((d, *plain_contamination(t)) for d, t, *_ in TEXTS), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=repr) == want
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in got}
    assert [TEXTS[0][1][a:b] for a, b in spans[0]] == [ITEM.upper()] and len(spans[4]) == 1 and spans[8] == []
    kept = decontaminate.decontaminated(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 4, 5, 6, 7, 8} & {r.doc_id for r in got if not r.contaminated}


def test_contamination_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


PERSONAL = [
    (0, "Mail a.b_c%+d@x-y.example.com, or +1 (017) 555-7713 now. 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5.6.7.8"),
    (1, None), (2, ""), (3, "card 4111 1111 1111 1111 ok, 4111-1111-1111-1112 not, 4111  1111 1111 1111 apart, 12345678901234567890123"),
    (4, "é😀 a@b.c_d@e.f @x.y a@b a@b. x@-.- +9 +99 (12)-34.56 78 +1234567890123456 00.001.02.0003"), (5, "4" * 5000 + " " + "a" * 5000 + "@" + "1." * 2000),
    (3, "card 4111 1111 1111 1111 ok, 4111-1111-1111-1112 not, 4111  1111 1111 1111 apart, 12345678901234567890123"), (None, "5500005555555559 6"), (6, "1-2-3 4 5 6 7 8 9-0 1 2 3 4 5 6 7 8 9 0"),
]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_personal(text):
    text, out = text or "", []
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    for n, (regex, good) in enumerate(rules):
        out += [(m.start(), n, m.end()) for m in re.finditer(regex, text) if good(m[0])]
    return sorted(out)


def test_personal_data_base_spans(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in PERSONAL], "doc_id bigint, text string, base int, added int")
    got = pii.personal_data(docs).collect()
    assert sorted(((r.doc_id, [(s.start, s.rank, s.end) for s in r.base]) for r in got), key=repr) == sorted(((d, plain_personal(t)) for d, t in PERSONAL), key=repr)
    assert pii.personal_data(docs.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[0].startswith("Mail [email], or [phone] now. [ip] and 10.0.0.256")


def test_personal_data_by_context(spark):
    known = [(i, f"words before member number 4111111111111{i:03d} {'x' * (i % 90)}") for i in range(300)]
    good = [r for r in known if plain_personal(r[1])]
    unseen = [(1000, "words before member number AB-99-77-X1 end"), (1001, "words before some other 12345 end")]
    got = {r.doc_id: [(s.start, s.end) for s in r.added] for r in pii.personal_data(spark.createDataFrame(good + unseen, "doc_id bigint, text string")).collect()}
    assert got[1000] == [(27, 38)] and got[1001] == [] and not any(got[d] for d, _ in good)


def test_bootstrap_finds_what_no_base_pattern_does(spark):
    """Secrets by their shape's contexts, then other strings there; a base kind that seeds lack is found again by its contexts."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    prose = lambda n: " ".join(word() for _ in range(n))
    secrets = [(i, f'{prose(9)} token = "{rng.bytes(16).hex()}" {prose(5)}') for i in range(40)]
    letters = [(100, f'{prose(4)} TOKEN = "swordfish" {prose(4)}'), (101, "key:correct"), (102, "token = ")]
    mails = [(200 + i, f"{prose(5)} reach me at {word()}@{word()}.example, {prose(6)}") for i in range(60)]
    others = [(300 + i, f"{prose(5)} reach me at {word()}{i}, {prose(6)}") for i in range(3)]
    clean = [(400 + i, f"{prose(20)} token {prose(5)} = {prose(9)}") for i in range(40)]
    rows = secrets + letters + mails + others + clean + [(None, secrets[0][1]), (500, None), (501, "")]
    got = {r.doc_id: [(s.start, s.end) for s in r.added] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    text = dict(rows)
    cut = {d: [text[d][a:b] for a, b in spans] for d, spans in got.items() if spans}
    assert all(len(cut[i][0]) == 32 for i in range(40)) and cut[100] == ["swordfish"] and cut[None] == cut[0]
    assert all(cut[300 + i] == [text[300 + i].split("at ")[1].split(",")[0]] for i in range(3))
    assert set(cut) == {*range(40), None, 100, 300, 301, 302}


def test_patterns_left_out_of_look_ups_change_nothing(spark):
    """A wide context that other patterns' values save, and one that nothing saves, with and without the counts."""
    rng = np.random.default_rng(6)
    names = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(60)]
    key = lambda: rng.bytes(16).hex()
    rows = [(i, f'a token = "{key()}" end') for i in range(320)] + [(400 + i, f'a token = "{n}" end') for i, n in enumerate(names)]
    rows += [(500 + i, f"please give {n} now") for i, n in enumerate([*names, *(key() for _ in range(8)), "zebra"])]
    rows += [(600 + i, f"of the {w} we") for i, w in enumerate([*(key() for _ in range(8)), *("".join(rng.choice(list("klmnop"), 6)) for _ in range(90))])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = pii.scanned(docs)
    spans = lambda **o: sorted((r.doc_id, [(s.start, s.end) for s in r.added]) for r in pii.personal_data(docs, **o).collect())
    found, plain = spans(wide=20), spans(wide=1 << 40)
    assert found == plain and dict(found)[568] == [(12, 17)] and not any(dict(found)[600 + i] for i in range(8, 98))
    seeds = known.select(F.explode("seeds").alias("w")).select(F.explode(pii.patterns(F.col("w"))).alias("pattern"), *(F.col(f"w.{c}") for c in pii.CONTEXT_OF), "w.value")
    enough = seeds.groupBy("pattern").agg(F.countDistinct("value").alias("n"), *(F.min(c).alias(c) for c in pii.CONTEXT_OF)).where("n >= 5")
    assert {r.pattern for r in pii.hopeless(docs, enough, least=20).collect()} == {"L please give ", "B give  _  now", "L of the ", "B the  _  we"}


def test_tokens_and_neighbours(spark):
    rows = spark.createDataFrame([(1, "A\tbc  D=1"), (2, "\u0130x Y"), (3, None), (4, "")], "doc_id long, text string")
    out = pii.spelled(pii.tokens(rows, False)).select("doc_id", "place", "token", "p1", "p2", "nx").collect()
    # Two white spaces in a row leave an empty word; a text whose length changes in lower case keeps its own tokens.
    assert sorted(map(tuple, out)) == [
        (1, 0, "a", "", "", "bc"), (1, 1, "bc", "a", "", ""), (1, 3, "d=1", "", "bc", ""),
        (2, 0, "\u0130x", "", "", "y"), (2, 1, "Y", "i\u0307x", "", ""),
    ]


def test_letters_of_language_identification():
    known = langid.Scorer(["en"], np.full((2, 1), 0.5), ["a"])
    assert [known.predict([t])[0][0] for t in ("½", "²", "①", "Ⅷ", "12 _ -", "", None)] == ["und"] * 7
    assert [known.predict([t])[0][0] for t in ("é", "中", "ª", "a1", "ـ")] == ["en"] * 5


def test_predictions_equal_brute_force():
    """Every segmentation listed, on a small vocabulary; ties go to the first language."""
    vocabulary = ["▁", "a", "b", "ab", "▁a", "ba"]
    rng = np.random.default_rng(1)
    probs = rng.dirichlet(np.ones(7), 3).T
    probs[:, 1] = probs[:, 0]
    scorer = langid.Scorer(["de", "en", "fr"], probs, vocabulary)

    def ways(w):
        if not w:
            return np.ones(3)
        found = [n for n in range(1, 3) if w[:n] in vocabulary and n <= len(w)]
        total = sum((probs[vocabulary.index(w[:n])] * ways(w[n:]) for n in found), np.zeros(3))
        return total if 1 in found else total + probs[6] * ways(w[1:])

    for text in ("a", "ab ba", "abba b", "axb", "bab aab b"):
        p = np.prod([ways("▁" + w) for w in text.split()], axis=0)
        lang, score = scorer.predict([text])[0]
        assert lang == ("de" if p[0] >= p[2] else "fr") and abs(score - max(p) / p.sum()) < 1e-9


def test_language_identification(spark):
    say = {"en": "the house of the river was there with that thing and the weather ", "fr": "la maison est dans le jardin avec des fleurs pour une femme ", "de": "das haus und der garten sind nicht so gross wie die strasse "}
    rows = [(i, say[k] * (1 + i % 3), k) for i in range(120) for k in [("en", "fr", "de")[i % 3]]]
    rows += [(200, None, "en"), (201, "", "fr"), (202, "12 34 !?", "de"), (203, "the weather there", None), (None, "der garten und das haus", None), (204, "the " * 5000, "en"), (204, "the " * 5000, "en"), (205, "q" * 20_000, "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, score string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[k] for k in (200, 201, 202, 203, None, 204)] == ["und", "und", "und", "en", "de", "en"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in got)
    assert all(by[i] == rows[i][2] for i in range(120))
    kept = langid.identified(docs)
    assert kept.columns == docs.columns and {200, 201, 202}.isdisjoint(r.doc_id for r in kept.collect())
    unlabelled = langid.identify(docs.withColumn("lang", docs.lang.substr(99, 1)).where("lang <> ''"))
    assert unlabelled.count() == 0


def test_forward_sums_all_segmentations():
    vocabulary = ["▁", "a", "b", "ab", "▁a", "aba", "ba"]
    lattice = langid.Lattice(vocabulary)
    probs = np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.2, 0.3], [0.1, 0.1], [0.2, 0.1], [0.1, 0.1], [1e-7, 1e-7]])

    def brute(word, k):
        if not word:
            return 1.0
        out = sum(probs[i, k] * brute(word[len(p) :], k) for i, p in enumerate(vocabulary) if word.startswith(p))
        return out + (1e-7 * brute(word[1:], k) if word[0] not in "▁ab" else 0)

    words = ["▁ab", "▁aba", "▁", "▁xab", "▁" + "ab" * 7, "▁b", "▁ab" + "a" * 9]
    want = np.log([[brute(w, k) for k in (0, 1)] for w in words])
    assert np.allclose(lattice.scores(words, probs), want)
    long = "▁" + "ab" * 3000
    assert np.isfinite(lattice.scores([long], probs)).all()
    counts = lattice.expected(["▁ab"], np.array([2.0]), probs[:, 0])
    total = brute("▁ab", 0)
    assert np.isclose(counts[3], 2 * probs[0, 0] * probs[3, 0] / total) and np.isclose(counts[4], 2 * probs[4, 0] * probs[2, 0] / total)


ODD = ["a?. b ,. c.. d. e... f,\n.g 5. x, y.", "don.t. it's. ’. a×. b÷, c", "a\t. b\x0b, \x1c. x\x1d, y <|endoftext|>. _. a_.", "ÀÉ. SS. ß. ª. µ, Ω. Σ. aΣ. İ", "日本語、テスト. हिन्दी", "a" * 20_000, "", None, "it's I'LL. don't,", "x " * 30_000]


@pytest.mark.parametrize("file_ids", [50, 1 << 20])
def test_token_files_round_trip(spark, file_ids):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    rows = [(i, x) for i, x in enumerate(ODD)] + [(3, "again"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, start bigint")
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in tokens.round_trip(docs, file_ids=file_ids).collect()}
    want, start = {}, 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want[d, start] = len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert got == want
    assert tokens.round_trip(docs.limit(0)).count() == 0


def test_rans_blocks_and_damage():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 70_000) - 1, 40_000).astype(np.uint32)
    ids[5] = 49_000
    lengths = [0, 1, 60_000, 9_999]
    out = []
    rans.pack_file(ids, [3, None, 4, 5], lengths, out.append, block_ids=1 << 14)
    data = b"".join(out)
    assert len(data) < ids.size * 2
    r = rans.Reader(lambda a, n: data[a : a + n], len(data))
    back = list(r.documents())
    assert [d for d, _ in back] == [3, None, 4, 5] and (np.concatenate([i for _, i in back]) == ids).all() and len(r.checkpoints) == 5
    assert (r.block(2) == ids[2 << 14 : 3 << 14]).all()
    bad = bytearray(data)
    bad[r.checkpoints[1][0] + 9000] ^= 1
    with pytest.raises(ValueError):
        rans.Reader(lambda a, n: bytes(bad[a : a + n]), len(bad)).block(1)
    with pytest.raises(ValueError):
        rans.Reader(lambda a, n: data[:-1][a : a + n], len(data) - 1)
    one = []
    rans.pack_file(np.zeros(3, np.uint32), [1], [3], one.append)
    assert hashlib.sha256(b"".join(one)).hexdigest() and rans.quantised(np.array([0, 5, 0, 1])).sum() == 1 << rans.TABLE_BITS
