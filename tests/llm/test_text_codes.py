"""Tokens and fingerprints against the library and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from odd import ROWS, documents, texts
from tokenizers import Tokenizer

from lectern.llm import bpe, fingerprints, token_files
from lectern.session import scratch_path

WORD_FILE, BYTE_FILE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(WORD_FILE)
    want = Counter()
    for i, text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(bpe.encode_documents(documents(spark), WORD_FILE)).collect()) == want
    assert bpe.encode_documents(documents(spark, []), WORD_FILE).count() == 0


def test_bpe_random_words_and_memory_bound():
    library, rng = Tokenizer.from_file(WORD_FILE), random.Random(3)
    encoder = bpe.TextEncoder(WORD_FILE, limit=5000, block=700)
    for _ in range(60):
        text = " ".join("".join(rng.choice("aabeinrst'.1ßé漢🙂Σ") for _ in range(rng.randint(1, 14))) for _ in range(20))
        (n, ids, decoded), = encoder.encode_batch([text])
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), library.decode(want, skip_special_tokens=False))


def test_token_files_round_trip(spark):
    library, path = Tokenizer.from_file(BYTE_FILE), scratch_path(spark, "tokens")
    token_files.write_tokens(documents(spark), path, BYTE_FILE)
    read = token_files.read_tokens(spark, path)
    got = {(r["doc_id"], r["start"]): list(r["ids"]) for r in read.collect()}
    assert len(got) == len(ROWS)
    at = 0
    for (doc_id, start), ids in sorted(got.items(), key=lambda x: x[0][1]):
        assert start == at
        at += len(ids)
    assert [k[0] for k in sorted(got, key=lambda k: k[1])][-1] is None  # null ids last
    want = Counter((i, tuple(library.encode(t, add_special_tokens=False).ids) + (0,)) for i, t in texts())
    assert Counter((k[0], tuple(v)) for k, v in got.items()) == want
    for r in token_files.checksums(read).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(got[r["doc_id"], r["start"]], "<u4").tobytes())
    assert {r["doc_id"] for r in token_files.lookup_tokens(spark, path, [5, 7]).collect()} == {5, 7}
    assert token_files.checksums(token_files.encode_to_files(documents(spark, []), BYTE_FILE)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b\n c", "x \n y", " lead", "trail ", "a  b", "I'm 'll  it's", "<|endoftext|> a b"])
def test_pieces_equal_the_library(text):
    library = Tokenizer.from_file(BYTE_FILE)
    got, = token_files.PieceEncoder(BYTE_FILE).encode_batch([text])
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_fingerprints_by_brute_force(spark):
    got = [r.asDict() for r in fingerprints.fingerprint_documents(documents(spark)).collect()]
    order = sorted(texts(), key=lambda r: (r[0] is None, r[0] or 0))
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in order)
    rows = {r["doc_id"]: r for r in got}
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        if i == 9:
            continue  # three equal rows: the last of them looks ahead
        cut = len(text) // 4
        edited = text[:len(text) - cut] + following[:cut]
        own, other, after = (fingerprints.fingerprint(t.encode()) for t in (text, edited, following))
        assert rows[i]["n_chars"] == len(text)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (fingerprints.spelled(own), fingerprints.spelled(other))
        assert rows[i]["near_edited"] == fingerprints.containment(own, other)
        assert rows[i]["near_next"] == fingerprints.containment(own, after)
    assert rows[1]["fingerprint"] == rows[8]["fingerprint"]
    assert 0.6 < rows[7]["near_edited"] < 0.9
    assert fingerprints.fingerprint_documents(documents(spark, [])).count() == 0
    alone = fingerprints.fingerprint_documents(documents(spark, [(1, "only one document", "s")])).first()
    assert alone["near_next"] == 1.0


def test_gear_hash_and_cuts():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    hashes = fingerprints.gear_hashes(data)
    for i in (0, 1, 31, 32, 4999):
        window = data[max(0, i - 31):i + 1][::-1]
        assert int(hashes[i]) == sum(int(fingerprints._GEAR[b]) << k for k, b in enumerate(window)) % 2 ** 32
    cuts = fingerprints.cut_points(data)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == 5000 and sizes.max() <= fingerprints.MOST and (sizes[:-1] >= fingerprints.LEAST).all()
    # an insertion moves the boundaries near it only
    longer = np.concatenate([data[:1000], np.frombuffer(b"inserted", np.uint8), data[1000:]])
    moved = {c - 8 for c in fingerprints.cut_points(longer) if c > 2000}
    assert len(moved & set(cuts)) > 0.9 * len(moved)
    assert re.fullmatch(r"([0-9a-f]{9,10} ?)+", fingerprints.spelled(fingerprints.fingerprint(data.tobytes())))
