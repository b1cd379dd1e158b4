import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from marginalia.llm import token_files as tf
from marginalia.llm.pieces import Encoded, Recent, Tokenizer, id_bytes
from marginalia.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [" ", "  ", "\n", "\n\n", "\n ", " \n", "\t", "\r\n", "a", "the", "É", "'s", "'", "12", "½", "²", ".", "!!", "***", "<|endoftext|>", "’", " ", "日本", "\u001c", "_", "‍", "\U0001f600", "\u0000", "　", "q" * 70]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer(PATH)


def test_pieces_give_the_library_s_ids(tokenizer):
    rng = random.Random(3)
    kind, value = id_bytes(tokenizer.vocabulary)
    encoded, lengths = Encoded(tokenizer, value, b"".join, room=300), Encoded(tokenizer, len, sum, room=300)
    for _ in range(15):
        texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(400)]
        want = tokenizer.encode(texts)
        assert [np.frombuffer(x, kind).tolist() for x in encoded.texts(texts)] == want
        assert lengths.texts(texts) == [len(w) for w in want]


def test_recent_keeps_what_is_used():
    r = Recent(2, {"f": 0})
    for k in "abc":
        assert r.unknown([k]) == [k]
        r[k] = k
    assert r.unknown(["a", "f", "d"]) == ["d"] and r["a"] == "a"


def test_counts(frame, awkward, tokenizer):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(awkward), PATH, frequent=8).collect())
    n = {t: len(tokenizer.encode([t or ""])[0]) for _, t in awkward}
    assert got == sorted((str(i), len((t or "").encode()), n[t], n[t] > 1024) for i, t in awkward)
    assert token_counts(frame([]), PATH).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64)
    raw = tf.pack(ids, bits)
    assert len(raw) == -(-1000 * bits // 8) and tf.unpack(raw, 1000, bits).tolist() == ids.tolist()


def test_random_access_over_blocks(tmp_path):
    docs = [np.arange(n, dtype=np.uint32) % 700 for n in (5, 0, 33, 1)]
    with open(tmp_path / "f", "wb") as out:
        assert tf.write_file(out, [7, None, 9, 9], docs, bits=10, block_ids=8) == 39
    with open(tmp_path / "f", "rb") as stream:
        f = tf.TokenFile(stream)
        assert f.doc_ids == [7, None, 9, 9]
        assert [f.document(i).tolist() for i in (2, 0, 3, 1)] == [docs[i].tolist() for i in (2, 0, 3, 1)]


def test_files(frame, awkward, tokenizer):
    got = sorted((r.start, str(r.doc_id), r.n_tokens, r.ids_crc32) for r in tf.token_files(frame(awkward), PATH, file_ids=500).collect())
    order = sorted(awkward, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    start, want = 0, []
    for i, t in order:
        ids = [*tokenizer.encode([t or ""])[0], 2]
        want.append((start, str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert tf.token_files(frame([]), PATH).count() == 0
