"""Cases that every operator must take: null keys, repeats, a very long text, empty tables, clashing columns; and what round trips show."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from evenhand.llm import decontamination, jaccard_join, lm_scoring, packing, pii, quality_classifier, quality_rules, sharding, suffix_dedup, tables, token_counts

CLASH = ["_row", "_k", "_new", "_hit", "id", "t", "_h", "_pii", "ranges", "bucket"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH)


def text(rng, n):
    return " ".join(f"w{rng.integers(4000)}" for _ in range(n))


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.fixture(scope="module")
def given():
    rng = np.random.default_rng(11)
    a, b = text(rng, 200), text(rng, 90)
    long = text(rng, 350_000)  # about 2 MB
    return [(1, a), (2, b), (2, b), (None, a), (None, None), (3, None), (4, ""), (5, long), (6, "mail bob@x.com now " + text(rng, 30)), (7, a + " end")]


@pytest.fixture(scope="module")
def docs(spark, given):
    return spark.createDataFrame([(i, t, "s", *CLASH) for i, t in given], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def items(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id string, text string")


def operators(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    return {
        "lengths": lambda d: token_counts.token_lengths(d, path("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN),
        "shards": lambda d: sharding.balanced_shards(d, 4),
        "pii": lambda d: pii.pseudonymise(d, "k"),
        "jaccard": jaccard_join.similar_groups,
        "packing": lambda d: packing.pack(packing.pieces(d, path("word_bpe_49k.json"))),
        "repeats": suffix_dedup.repeated_bytes,
        "without": suffix_dedup.without_repeats,
        "contamination": lambda d: decontamination.digest(decontamination.contamination(d, items(spark))),
        "classifier": lambda d: quality_classifier.scored(d, quality_classifier.train(d, labels)),
        "language model": lm_scoring.scored,
        "rules": quality_rules.judged,
    }


def test_hard_rows_keep_their_number(spark, docs, given):
    for name, f in operators(spark).items():
        if name != "packing":
            assert f(docs).count() == len(given), name


def test_empty_tables_give_nothing(spark, empty):
    for name, f in operators(spark).items():
        assert f(empty).count() == 0, name


def test_stages_keep_columns_whatever_their_names(spark, docs, given):
    bench = items(spark, [("x", " ".join(words(given[0][1])[20:40]))])
    stages = {
        "quality": (quality_rules.keep_good, Counter((i, t) for i, t in given if len(words(t)) >= 20)),
        "near duplicates": (jaccard_join.one_of_each, None),
        "decontamination": (lambda d: decontamination.remove_contaminated(d, bench), None),
        "slices": (lambda d: decontamination.remove_contaminated(d, bench, slice_rows=3), None),
    }
    found = {}
    for name, (f, want) in stages.items():
        out = f(docs)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all([r[c] for c in CLASH] == CLASH for r in rows), name
        found[name] = Counter((r["doc_id"], r["text"]) for r in rows)
        assert want is None or found[name] == want, name
    a = given[0][1].split()
    cut = " ".join(a[:20]) + "  " + " ".join(a[40:])
    want = Counter((i, t.replace(given[0][1], cut) if t else t) for i, t in given)
    assert found["decontamination"] == found["slices"] == want
    assert found["near duplicates"] == Counter([(1, given[0][1]), (2, given[1][1]), (None, None), (3, None), (4, ""), given[7], given[8]])


def test_lengths_and_limits(spark, given):
    import public_tokenizers
    import tiktoken

    from evenhand.llm.encoders import RankFile

    odd = [t for _, t in given] + ["isn't  12 it's!!", "日本 語\n\n x", "<|endoftext|>", " a", "é" * 50, "\r\n\t"]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    lengths = token_counts.token_lengths(df, path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = RankFile(path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).library
    assert isinstance(library, tiktoken.Encoding)
    want = [len(library.encode_ordinary(t or "")) for t in odd]
    assert Counter(r[0] for r in lengths.collect()) == Counter(want)
    histogram = token_counts.length_histogram(lengths)
    for r in token_counts.at_limits(histogram, [0, 10, 400]).collect():
        c = r["context"]
        assert (r["tokens"], r["docs_over"], r["tokens_cut"]) == (sum(want), sum(n > c for n in want), sum(min(n, c) for n in want))
    for q in (0.1, 0.5, 1.0):
        assert token_counts.length_quantile(histogram, q).first()[0] == sorted(want)[math.ceil(q * len(want)) - 1]


def test_shards_are_balanced(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, "x" * int(n)) for i, n in enumerate(rng.integers(50, 3000, 2000))], "doc_id long, text string")
    sums = [r[1] for r in sharding.balanced_shards(docs, 16, chunk=300).groupBy("shard").sum("size").collect()]
    assert len(sums) == 16 and max(sums) - min(sums) < 0.005 * np.mean(sums)


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(30)]
    one = lambda n: " ".join(rng.choice(vocabulary, n))
    bench = [(str(i), one(n)) for i, n in enumerate([12, 25, 10, 3, 1])] + [("b", "Shared PASSAGE, of: ten words and more to be found here"), ("a", "Shared passage of ten words and more to be found here"), ("n", None)]
    texts = [one(n) for n in (0, 1, 5, 40, 200, 300)] + [bench[1][1] + " " + one(20), "x shared-passage of ten WORDS and more to be found here y", bench[0][1][5:], None, "日本 " + bench[2][1]]
    rows = list(enumerate(texts))
    ws = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in bench:
        w = ws(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    import hashlib

    want = set()
    for d, t in rows:
        w, mark, own = ws(t), set(), set()
        for g, which in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    mark |= set(range(k, k + len(g)))
                    own |= which
        want.add((d, len(w), len(mark), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(mark)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (10**6, 5):
        assert set(map(tuple, decontamination.digest(decontamination.contamination(docs, items(spark, bench), slice_rows=limit)).collect())) == want


def test_classifier_learns_from_the_other_folds(spark):
    rng = np.random.default_rng(6)
    rows = [(i, text(rng, 80) if i % 2 else " | ".join(["BUY NOW!!"] * 20), int(i % 2)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, source string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id long, quality int")  # those held out are wrong
    for r in quality_classifier.scored(docs, quality_classifier.train(docs, labels)).collect():
        assert r["held_out"] == (r["doc_id"] in held) and r["predicted"] == r["doc_id"] % 2 == (r["score"] >= 0.3)


def test_statistics_against_plain_counts():
    import pyarrow as pa

    t = "Hello, hello WORLD 42!\nsame line\nsame line\n| é"
    x = dict(zip(quality_classifier.STATISTICS, quality_classifier.statistics(pa.array([t, "", None]))[0], strict=True))
    raw, w = t.encode(), t.split()
    assert x["log_bytes"] == pytest.approx(math.log1p(len(raw))) and x["log_words"] == pytest.approx(math.log1p(len(w)))
    assert x["upper"] == pytest.approx(sum(c.isupper() for c in t) / len(raw)) and x["digits"] == pytest.approx(2 / len(raw)) and x["pipes"] == pytest.approx(1 / len(raw))
    assert x["word_length"] == pytest.approx(sum(len(v.encode()) for v in w) / len(w)) and x["dup_lines"] == pytest.approx(1 / 4)
    assert (quality_classifier.statistics(pa.array(["", None])) == [float(n == "distinct_words") for n in quality_classifier.STATISTICS]).all()


def test_score_against_a_plain_model(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e"], 30, p=[0.4, 0.3, 0.1, 0.1, 0.1]))) for i in range(60)] + [(70, None), (71, "new words")]
    seq = {i: [*words(t), "\0"] for i, t in rows}
    fold = lambda i: zlib.crc32(str(i).encode()) % lm_scoring.FOLDS
    learn = {i: s for i, s in seq.items() if fold(i) != lm_scoring.HELD_OUT}
    one = lambda docs: Counter(x for s in docs for x in s)
    two = lambda docs: Counter(p for s in docs for p in zip(["\0", *s[:-1]], s))
    c, pair = one(learn.values()), two(learn.values())
    n, types = sum(c.values()), len(c)
    deleted = [s for i, s in learn.items() if fold(i) == lm_scoring.DELETED]
    kept = [s for i, s in learn.items() if fold(i) != lm_scoring.DELETED]
    kc, kp = one(kept), two(kept)
    n_kept = sum(kc.values())
    seen = Counter()
    for s in deleted:
        for b, x in zip(["\0", *s[:-1]], s):
            if kc[b]:
                r = kp[b, x] / kc[b] * (n_kept + types + 1) / (kc[x] + 1)
                step = int(np.round(np.log2(r) * lm_scoring.STEPS)) if r else lm_scoring.NONE
                seen[int(lm_scoring.context_bucket(np.array([kc[b]]))[0]), step] += 1
    lam = lm_scoring.weights([(*k, v) for k, v in seen.items()])

    def log_p(s):
        total = 0.0
        for b, x in zip(["\0", *s[:-1]], s):
            w = lam[lm_scoring.context_bucket(np.array([c[b]]))[0]] if c[b] else 0.0
            total += math.log10(w * pair[b, x] / max(c[b], 1) + (1 - w) * (c[x] + 1) / (n + types + 1))
        return total

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in lm_scoring.scored(docs, chunk_bytes=300).collect():
        assert r["score"] == pytest.approx(log_p(seq[r["doc_id"]]), abs=1e-6), r["doc_id"]


def test_host_verdicts_decide(spark):
    rng = np.random.default_rng(8)
    good = lambda: text(rng, 60)
    soft = lambda: text(rng, 30) + " " + "#" * 60
    rows = [(f"h{h}", good() if k > 4 else soft()) for h in range(6) for k in range(20)]  # a quarter fails softly
    rows += [("bad", "too short")] * 55 + [("bad", good()) for _ in range(5)]
    rows += [("small", "too short")] * 5 + [("small", good())]  # nearly the same raw rate
    rows += [("clean", good()) for _ in range(3000)] + [("clean", soft())]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = defaultdict(list)
    for r in quality_rules.judged(docs).collect():
        got[r["source"], r["host_verdict"], r["base_failed"], 10 * r["n_symbols"] > r["word_chars"]].append(r["kept"])
    assert got["bad", "bad", False, False] == [False] * 5  # a bad host loses documents that pass the rules
    assert got["small", "ordinary", False, False] == [True]  # a small one with as bad a raw rate does not
    assert got["clean", "trusted", False, True] == [True]  # a trusted host's soft failure is forgiven
    assert got["h0", "ordinary", False, True] == [False] * 5 and all(got["h0", "ordinary", False, False])


def test_pipeline_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(9)
    base = [text(rng, n) for n in (60, 90, 120, 200, 6000)]
    passage = text(rng, 15)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[0]), (11, base[1] + " tail"), (12, "too few words"), (13, None), (14, ""), (15, base[2][:300] + " " + passage + " " + text(rng, 40)), (16, passage), (None, base[3])]
    rows += [(17, text(rng, 40) + " ip 10.2.3.4 end"), (18, passage + " " + text(rng, 5))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items(spark, [("q", passage)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i: t for i, t in rows if len(words(t)) >= 20 and i is not None}
    for twin in (10, 11):
        del kept[twin]
    kept[15] = kept[15].replace(passage, "")
    del kept[18]  # more than half is benchmark
    moved = pii.pseudonymise(spark.createDataFrame([(kept[17],)], "text string"), corpus_pipeline.PII_KEY).first()["text"]
    assert moved != kept[17]
    kept[17] = moved
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in kept.items():
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.update((i, p, 4096 * p, len(part := ids[4096 * p : 4096 * p + 4096]), zlib.crc32(part.tobytes())) for p in range(-(-len(ids) // 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        ends = [0, *(o + n for o, n in sorted(b))]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 4096


def test_written_tables_can_be_discarded(spark):
    df = tables.written(spark.range(3).toDF("a"))
    assert df.count() == 3
    place = tables.shared_dir(spark).removeprefix("file:")
    import os

    assert os.listdir(re.sub("^//(?=/)", "", place))
    tables.discard(spark)
    assert not os.path.exists(re.sub("^//(?=/)", "", place))
