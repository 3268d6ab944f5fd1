import random

import numpy as np
import pytest

from gridloom.llm import bpe
from gridloom.llm.queries.op04 import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return bpe.Vocabulary.load(path), library


def test_ids_and_decoding_are_the_librarys(both):
    vocabulary, library = both
    r = random.Random(3)
    texts = ["", "  ", "it's I'LL we've ''s", "Ça É́ ΣΑΣ İstanbul x\u00a0y \x1c a\x85b", "<|endoftext|> a<|startoftext|>b", "日本 👩‍💻 123 ①½ x² __a__ á ́b"]
    texts += ["".join(r.choices("etaoinshrdlu", k=r.randint(1, 14))) for _ in range(3000)]
    texts += ["".join(r.choices("aabn!.-= é1", k=r.randint(1, 24))) for _ in range(2000)]
    got = bpe.Encoder(vocabulary).encode([t.encode() for t in texts])
    for text, (ids, told), want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == want.ids, text
        assert told.decode() == library.decode(want.ids, skip_special_tokens=False)


def test_other_vocabularies_are_refused(both, tmp_path):
    import json

    with open(vocabulary_path(), encoding="utf-8") as f:
        whole = json.load(f)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Whitespace"}]}}, {"model": whole["model"] | {"byte_fallback": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(whole | change))
        with pytest.raises(ValueError, match="another way"):
            bpe.Vocabulary.load(str(path))
    lacking = bpe.Vocabulary({k: v for k, v in both[0].ids.items() if k not in ("q", "q</w>")}, [m for m in both[0].merges if "q" not in m[0] + m[1]], {})
    with pytest.raises(ValueError, match="no encoding"):
        bpe.Encoder(lacking).encode([b"q"])


def test_one_text_of_megabytes(both):
    text = " ".join(f"word{i % 9973} it's {i}" for i in range(150_000))
    ((ids, told),) = bpe.Encoder(both[0]).encode([text.encode()])
    want = both[1].encode(text, add_special_tokens=False)
    assert len(text) > 2_000_000 and np.frombuffer(ids, dtype="<u4").tolist() == want.ids and told.decode() == both[1].decode(want.ids, skip_special_tokens=False)


def test_forgetting_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder, texts = bpe.Encoder(both[0]), [b"one two three four", b"five six one two", b"three four seven", b"one two"]
    assert [encoder.encode([t])[0] for t in texts] == bpe.Encoder(both[0]).encode(texts)


def test_messy_and_empty_tables(spark, messy, none, both):
    encoded = bpe.encode(messy, both[0])
    rows = bpe.digest(encoded).collect()
    assert len(rows) == messy.count() and {r.n_tokens for r in rows if r.doc_id in (3, 4, 6)} == {0}
    again = {(r.doc_id, r.decoded) for r in bpe.decode(encoded, both[0]).collect()}
    assert again == {(r.doc_id, r.decoded) for r in encoded.collect()}
    assert bpe.encode(none, both[0]).count() == 0
