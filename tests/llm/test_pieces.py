"""Piece models of both kinds against the library, and words of any length."""

import random
import struct
import tracemalloc

import numpy as np
import pytest

from tessera.llm import pieces


def ids(data):
    return np.frombuffer(data, "<i4").tolist()


def message(*fields):
    """A protocol buffer message of (number, value) with integers, floats, bytes."""
    out = b""

    def varint(n):
        b = b""
        while n > 127:
            b += bytes([n & 127 | 128])
            n >>= 7
        return b + bytes([n])

    for k, v in fields:
        if isinstance(v, bytes):
            out += varint(k << 3 | 2) + varint(len(v)) + v
        elif isinstance(v, float):
            out += varint(k << 3 | 5) + struct.pack("<f", v)
        else:
            out += varint(k << 3) + varint(v)
    return out


def unigrams(kind=1, normal=((3, 1), (4, 0), (5, 1))):
    """A made-up vocabulary with scores; nothing is trained."""
    r = random.Random(3)
    pieces_ = ["▁", *"abcde", "é", "日", "本"]
    pieces_ += sorted({"".join(r.choice("abcde") for _ in range(r.randint(2, 5))) for _ in range(120)} | {"▁" + "".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(80)} | {"▁▁", "日本"})
    proto = message((1, message((1, b"<unk>"), (2, 0.0), (3, 2))), (1, message((1, b"<s>"), (2, 0.0), (3, 3))), (1, message((1, b"</s>"), (2, 0.0), (3, 3))))
    proto += b"".join(message((1, message((1, f"<0x{i:02X}>".encode()), (2, 0.0), (3, 6)))) for i in range(256))
    proto += b"".join(message((1, message((1, p.encode()), (2, -r.uniform(1, 12))))) for p in pieces_)
    return proto + message((2, message((3, kind), (35, 1))), (3, message((1, b"identity"), *normal)))


def test_scored_pieces_like_the_library():
    import sentencepiece

    own, sp, r = pieces.Pieces(unigrams()), sentencepiece.SentencePieceProcessor(model_proto=unigrams()), random.Random(4)
    assert own.kind == pieces.UNIGRAM
    texts = ["".join(r.choice("abcde é日本x ") for _ in range(r.randint(0, 60))) for _ in range(400)] + ["a  b", "   ", "abcabc" * 200, "🙂"]
    for t, got in zip(texts, own.encode(texts), strict=True):
        assert ids(got) == sp.encode(t) and own.decode(np.frombuffer(got, "<i4")) == t


def test_scored_pieces_are_the_best():
    own, r = pieces.Pieces(unigrams()), random.Random(5)
    for _ in range(60):
        w = "▁" + "".join(r.choice("abcde") for _ in range(r.randint(1, 8)))
        best = {0: 0.0}
        for end in range(1, len(w) + 1):
            best[end] = max(best[a] + own.score[w[a:end]] for a in range(end) if w[a:end] in own.score)
        assert sum(own.score[own.names[i]] for i in ids(own.packed([w])[w])) == pytest.approx(best[len(w)])


def test_other_models_are_refused():
    for proto in (unigrams(kind=4), unigrams(normal=((3, 1), (4, 1), (5, 1))), unigrams(normal=((2, b"map"), (3, 1), (4, 0), (5, 1)))):
        with pytest.raises(ValueError):
            pieces.Pieces(proto)


def test_a_word_of_a_megabyte():
    import sentencepiece

    own, r = pieces.Pieces(open(pieces.default_model(), "rb").read()), random.Random(6)
    text = "".join(r.choice("我们今天去学校日本語タベル漢字ΩЖab9") for _ in range(350_000))
    assert len(text.encode()) > 900_000
    own.encode([text[:1000]])
    tracemalloc.start()
    got = own.encode([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(text) + (20 << 20) and not any(len(w) > pieces.KEPT for w in own.memory)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert ids(got) == sp.encode(text) and own.decode(np.frombuffer(got, "<i4")) == text


def test_frequent_words_and_pairs_are_worked_out_once(monkeypatch):
    """The memories fill up and turn over, but what each batch holds stays."""
    monkeypatch.setattr(pieces, "MEMORY", 20)
    monkeypatch.setattr(pieces, "PAIRS", 200)
    import sentencepiece

    own, done = pieces.Pieces(open(pieces.default_model(), "rb").read()), []
    packed = own.packed
    own.packed = lambda words: done.extend(words) or packed(words)
    sp, r = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), random.Random(8)
    for n in range(40):
        text = "frequent words " + " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(6))
        assert ids(own.encode([text])[0]) == sp.encode(text)
        assert len(own.memory) + len(own.before) <= 20 + 3 * 8 and len(own.apart) + len(own.apart_before) <= 200
    assert done.count("▁frequent") == done.count("▁words") == 1
