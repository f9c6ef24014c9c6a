"""SentencePiece encoding and decoding against the library, character by character odd texts included."""

import hashlib
import random

import pytest

from paperloom.llm import pieces
from paperloom.llm.queries import vocabulary

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=vocabulary(MODEL))


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.read_model(vocabulary(MODEL)))


@pytest.fixture(scope="module")
def decoder():
    return pieces.Decoder(pieces.read_model(vocabulary(MODEL)))


def odd_texts():
    rng = random.Random(3)
    yield from ["", " ", "  a", "a  ", "\x00a", "▁", "▁▁a ▁", "<s>", "<0x41>", "héé ₿   日本語 한국어 🙂🙂", "\n\n  \t x", "══ a"]
    for k in range(1, 60):
        yield from [" " * k, " " * k + "the", "a" + " " * k + "t", "=" * k, "-" * k + " " * k, "aaaa" * k]
    kinds = ["etaoinshrdlu ", "  ab", "é日本éô🙂 ak", "=-/*# \n", "0123 9.,", " \tthe"]
    for _ in range(4000):
        kind = rng.choice(kinds)
        yield "".join(rng.choice(kind) for _ in range(rng.randrange(1, 60)))


def test_encodes_and_decodes_as_the_library(library, encoder, decoder):
    rng = random.Random(7)
    texts = list(odd_texts()) + ["".join(rng.choice(encoder.names) for _ in range(rng.randrange(1, 8))) for _ in range(4000)]
    for text in texts:
        ids = library.encode(text)
        assert encoder.encode(text) == ids, text
        assert decoder.decode(ids) == library.decode(ids), text


def test_decodes_any_ids_as_the_library(library, decoder):
    rng = random.Random(11)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 28705]) for _ in range(rng.randrange(9))]
        assert decoder.decode(ids) == library.decode(ids), ids


def test_the_table_holds_the_last_piece_of_every_prefix(encoder):
    for word in ("▁international", "▁antidisestablishment", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁the", "zzzzzzz"):
        last = encoder.table(word)
        assert [encoder.names[p] for p in last[1:]] == [pieces.merged(word[:n], encoder.scores)[-1] for n in range(1, len(word) + 1)]


def test_very_long_texts_keep_bounded_tables(library, encoder, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(pieces, "CORES_KEPT", 50)
    monkeypatch.setattr(pieces, "PAIRS_KEPT", 500)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(30000)) + " and so on" * 3000
    assert encoder.encode(text) == library.encode(text)
    assert len(encoder.cores) <= 50


def test_documents_with_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "Some text.", "x", 3), (2, None, None, None), (3, "", "", 0), (None, "Some text.", "x", 1), (1, "Some text.", "x", 3), (4, "Ö 🙂" * 500, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int").repartition(3)
    found = sorted(map(tuple, pieces.round_trip(docs, vocabulary(MODEL)).collect()), key=repr)
    wanted = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "")
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids) if ids else "")]
        wanted.append((doc_id, len(ids), *shas))
    assert found == sorted(wanted, key=repr)
    encoded = pieces.encode_documents(docs, vocabulary(MODEL))
    texts = pieces.decode_documents(encoded, vocabulary(MODEL)).collect()
    assert sorted(map(tuple, texts), key=repr) == sorted([(r[0], r[1] or "") for r in rows], key=repr)
    assert pieces.round_trip(docs.where("false"), vocabulary(MODEL)).collect() == []


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as formats

    proto = formats.ModelProto()
    proto.ParseFromString(vocabulary(MODEL))
    proto.pieces[300].type = formats.ModelProto.SentencePiece.USER_DEFINED
    with pytest.raises(ValueError):
        pieces.read_model(proto.SerializeToString())
