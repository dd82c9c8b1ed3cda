"""Token files: the coder's round trip, damage, and ids against the library."""

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest

from evenhand.llm import range_coder, token_store
from evenhand.llm.encoders import BytePieces


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", ["skewed", "uniform", "constant", "extreme"])
def test_blocks_come_back(kind):
    rng = np.random.default_rng(1)
    n = 5 * 700 + 13
    ids = {"skewed": rng.zipf(1.3, n) % 50_000, "uniform": rng.integers(0, 1 << 16, n), "constant": np.full(n, 7), "extreme": rng.choice([0, 65_535], n)}[kind].astype(np.uint16)
    blocks = [ids[i : i + 700] for i in range(0, n, 700)]
    payloads = range_coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(payloads, [len(b) for b in blocks]), strict=True))
    # Blocks are independent: any one is read alone.
    assert (range_coder.decode([payloads[3]], [700])[0] == blocks[3]).all()
    size = sum(map(len, payloads))
    assert size < {"skewed": 1.6 * n, "uniform": 2.6 * n, "constant": 0.1 * n, "extreme": 0.5 * n}[kind]


def test_orders_help():
    rng = np.random.default_rng(2)
    follow = rng.integers(0, 50_000, 50_000)
    chain = [1]
    for _ in range(1500):
        chain.append(int(follow[chain[-1]]) if rng.random() < 0.9 else int(rng.integers(40)))
    known = range_coder.encode([np.array(chain, np.uint16)])[0]
    mixed = range_coder.encode([rng.permutation(np.array(chain, np.uint16))])[0]
    assert len(known) < 0.75 * len(mixed)


TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  ", "a  b", "a   b", "a\n b", "a \nb", "a\n\nb", "a\n \nb", "x   y", "don't  stop\n", "two\nlines here\nand more", "\tx\ty", "<|endoftext|> b\n <|endoftext|>", "Ünïcode čà 中文 ١٢ ½ \U0001f600 z", "a\x85 \x1c b", "1234 56,78 (x) ...", "end.\nStart of\r\nline \n"]


def test_chunks_equal_the_library():
    rng = np.random.default_rng(3)
    encoder = BytePieces(vocabulary())
    alphabet = list("ab é\n\t  '.1") + [" ", " ", "ll", "'s", " \n", "word", "\x1c", "\x85"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(alphabet, rng.integers(1, 30))) for _ in range(4000)]
    for t in texts + texts[:50]:
        want = np.array(encoder.library.encode(t, add_special_tokens=False).ids, np.uint16).tobytes()
        assert encoder.encode(t) == want, repr(t)


def test_letters_and_marks_go_to_the_model_alone(monkeypatch):
    encoder = BytePieces(vocabulary())
    texts = ["Plain words, in a line. And\nmore; of them: here!", "élan ÿþß, ǅungla? naïve.", *(f"{a}{chr(c)}{b}" for c in range(0x41, 0x250) if chr(c).isalpha() for a, b in (("", ","), ("x ", "y.")))]
    want = [np.array(encoder.library.encode(t, add_special_tokens=False).ids, np.uint16).tobytes() for t in texts]
    marks = {m: encoder.known(m, "") for m in ",.!?;:\n"}
    monkeypatch.setattr(encoder, "whole", lambda text: marks[text])  # nothing else is encoded whole
    assert [encoder.encode(t) for t in texts] == want


def test_files_hold_every_document(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = list(enumerate(TEXTS)) + [(None, "null key"), (None, None), (3, "again"), (3, "again"), (900, " ".join(f"w{rng.integers(3000)}" for _ in range(60_000)))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id long, text string, path string, start int").repartition(3)
    listed = token_store.write_ids(df, f"file://{tmp_path}/ids", vocabulary())
    got = token_store.read_ids(listed).collect()
    library = BytePieces(vocabulary()).library
    want = sorted(((k is not None, k or 0, zlib.crc32((t or "").encode())), k, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in rows)
    start = 0
    for r, (_, k, ids) in zip(sorted(got, key=lambda r: r["start"]), want, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (k, start, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        start += len(ids)
    assert sum(r["ids"] for r in listed.collect()) == start
    empty = token_store.write_ids(df.where("false"), f"file://{tmp_path}/none", vocabulary())
    assert token_store.read_ids(empty).count() == 0


def test_damage_is_seen():
    out = io.BytesIO()
    writer = token_store.Writer(out)
    for k in range(40):
        writer.add(k, np.arange(k, k + 300, dtype="<u2").tobytes())
    assert writer.close() == (40, 12_000, len(out.getvalue()))
    good = out.getvalue()
    read = lambda raw: list(token_store.documents_of(pa.BufferReader(raw)))
    assert [k for k, _ in read(good)] == list(range(40))
    for at in (9, len(good) // 2, len(good) - 60, len(good) - 3, 0):
        raw = bytearray(good)
        raw[at] ^= 1
        with pytest.raises(ValueError):
            read(bytes(raw))
    with pytest.raises(ValueError):
        read(good[:10])
