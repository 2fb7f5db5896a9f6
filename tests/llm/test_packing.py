import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from framelake.llm.packing import Packer, Piece, byte_level_encoder, pack_documents


def texts():
    rng = random.Random(5)
    out = [None, "", " ", "a", "<|endoftext|> x", "word " * 5000, "x" * 3000, "\n\n \t   　 z", "don't I'LL we've İǅ", "\U0001f600‍\U0001f525 กำ"]
    for _ in range(60):
        out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x4E00, 0x4F00), 32, 10, 39])) for _ in range(rng.randrange(300))))
        out.append(" ".join(rng.choice(["the", "of", "tion", "12,345", "x!"]) for _ in range(rng.randrange(2500))))
    return out


def test_ids_equal_tokenizers():
    encode = byte_level_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts():
        assert encode(t or "") == other.encode(t or "", add_special_tokens=False).ids


def test_very_long_runs():
    encode = byte_level_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for run in (" " * 2_000_000, "\n" * 2_000_000, "ab" * 1_000_000, "%$" * 1_000_000, "7" * 2_000_000):
        text = f"a{run}b"
        assert encode(text) == other.encode(text, add_special_tokens=False).ids


def test_round_trip(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(k, t, "clash") for k, t in enumerate(texts())]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, start string")).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(rows)))
    for k, t, _ in rows:
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0 and len(pieces) <= 64


def test_limits_hold_together():
    rng = np.random.default_rng(1)
    packer, bins, total = Packer(128, 4, 50, waiting=40), [], 0
    for k in range(400):
        n = int(rng.integers(1, 300 if k % 7 == 0 else 40))
        loss = rng.random(n) < rng.random()
        total += n
        bins += packer.add(Piece(k, 0, np.arange(n), loss, n))
    bins += packer.finish()
    for b in bins:
        size = sum(len(p.ids) for p in b)
        assert size <= 128 and size & (size - 1) == 0 and len(b) <= 4 and sum(int(p.loss.sum()) for p in b) <= 50
    assert sum(len(p.ids) for b in bins for p in b) == total


def test_loss_bearing_tokens_of_conversations(spark):
    """Prompts bear no loss; the three limits hold together, and the one on loss is what binds."""
    rng = random.Random(3)
    rows = [(k, t, ("user", "assistant", None)[t % 3], "".join(rng.choice(["the ", "of ", "x! "]) for _ in range(rng.randrange(400)))) for k in range(60) for t in range(rng.randrange(1, 6))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("conv_id * 100 + turn as example", "role = 'assistant' as answers", "text")
    out = pack_documents(turns, tokens=512, segments=8, key="example", loss="answers", loss_tokens=100).collect()
    answers, pieces = {k * 100 + t for k, t, role, _ in rows if role == "assistant"}, defaultdict(list)
    for r in out:
        pieces[r.sequence_id].append(r)
    for own in pieces.values():
        size = sum(r.length for r in own)
        assert size <= 512 and size & (size - 1) == 0 and len(own) <= 8 and sum(r.length for r in own if r.doc_id in answers) <= 100
    assert max(sum(r.length for r in own if r.doc_id in answers) for own in pieces.values()) == 100
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == {k * 100 + t for k, t, _, _ in rows}
    for own in by_doc.values():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == own[0].doc_tokens


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
