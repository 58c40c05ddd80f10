import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from strata.llm import bpe
from strata.llm.queries import op7_bpe_transducer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(1)
    out = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "\x1c\x1d x\x85y\xa0z \u180e k\u200b", "I'll don't 'S we've", "  \n\n  x  ", "é" * 400, "x" * 20_000]
    pool = [chr(i) for i in [*range(1, 0x250), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x660, 0xBD, 0x2160, 0x1F600, 0x4E00]]
    return out + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(400)]


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_transducer_holds_exactly_its_words(tmp_path):
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))): [rng.randrange(50_000) for _ in range(rng.randint(1, 3))] for _ in range(500)}
    place = str(tmp_path / "t.bin")
    bpe.Transducer.build(words, place)
    lexicon = bpe.Transducer(place)
    assert all(lexicon.lookup(w) == ids for w, ids in words.items())
    assert all(lexicon.lookup(w) is None for w in (b"", b"abcabcabc", b"zz", b"a" * 8))
    bpe.Transducer.build({}, place)
    assert bpe.Transducer(place).lookup(b"a") is None


def test_both_merges_agree():
    vocabulary = bpe.Vocabulary(PATH)
    rng = random.Random(3)
    for _ in range(500):
        word = bytes(rng.choice(b" abcdenrsti\xc3\xa9") for _ in range(rng.randint(1, 40)))
        assert vocabulary.merge(word) == vocabulary.merge(word, short=0)


def test_encoding_equals_the_library(spark, docs):
    library = Tokenizer.from_file(PATH)
    rows = [*enumerate(texts()), (900, None), (900, "twice"), (None, "null id")]
    got = sorted((tuple(r) for r in bpe.encode_documents(docs(rows), PATH, lexicon_words=50).collect()), key=str)
    assert got == sorted(((i, *wanted(library, t)) for i, t in rows), key=str)
    row = bpe.encode_documents(docs([(1, "some words")]), PATH, ids=True).first()
    assert row.token_ids == library.encode("some words").ids


def test_what_is_decoded_are_the_ids():
    vocabulary = bpe.Vocabulary(PATH)
    vocabulary.octets[vocabulary.ids[b" word"]] = b"?"
    assert bpe.Encoder(vocabulary, None).encode("a word")[1] == b"a?"


def test_empty_and_clashing_columns(spark, docs):
    assert bpe.encode_documents(docs([]), PATH).collect() == []
    odd = spark.createDataFrame([(1, "a", 2, 3)], "doc_id int, text string, n_tokens int, id int")
    assert bpe.encode_documents(odd, PATH).first().n_tokens == 1


def test_query_over_the_whole_table(spark):
    sf, library = "/root/testdata/sf0.001", Tokenizer.from_file(PATH)
    want = {r.doc_id: wanted(library, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r[0]: tuple(r[1:]) for r in op7_bpe_transducer(spark, sf).collect()} == want
