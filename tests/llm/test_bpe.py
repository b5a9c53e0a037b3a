import hashlib
import random

import numpy as np
import pytest

from demandloom.llm import bpe

PIECES = ["the quick ", "un", "believable", "'s", "'re", "'", "!!", "<|startoftext|>", "<|endoftext|>", "<|", "text|>", "É", "é", "́", "한국어", "한", "東京都", "😀👍🏽",
          "12", "٣", " ", "　", "\x1c", "\x85", "\n", "\t", " ", "ΣΑΣ", "İ", "ﬁ", "===", "____", "a1b2", "don't", "x̸", "≠", "�", "zzz"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.vocabulary())


def by_library(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def tree(coder, text, leaf):
    at = coder.cuts(text, leaf)
    nodes = [coder.leaf(text[a:b]) for a, b in zip(at, at[1:], strict=False)]
    while len(nodes) > 1:
        nodes = [coder.join(*nodes[i:i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return np.frombuffer(b"".join(nodes[0].ids()), "<u4").tolist()


def test_trees_equal_whole_encoding(library):
    coder, rnd = bpe.Coder(bpe.vocabulary()), random.Random(7)
    for n in range(600):
        few = rnd.sample(PIECES, rnd.randint(1, 6))
        text = "".join(rnd.choice(few) for _ in range(rnd.randint(1, 120)))
        want = library.encode(text, add_special_tokens=False).ids
        assert tree(coder, text, rnd.choice([3, 8, 17, 40])) == want, (n, text)
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == want


def test_words_of_latin_letters_go_the_short_way(library):
    coder, rnd = bpe.Coder(bpe.vocabulary()), random.Random(5)
    assert coder.plain
    for n in range(3000):
        w = "".join(chr(rnd.choice([rnd.randint(65, 122), rnd.randint(192, 0x24F)])) for _ in range(rnd.randint(1, 12))) + rnd.choice(["", ".", "),", "?\""])
        ids = library.encode(w, add_special_tokens=False).ids
        assert coder.word(w) == (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode()), w


def test_unsplit_runs(library):
    coder, rnd = bpe.Coder(bpe.vocabulary()), random.Random(8)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "東京都大阪한국", "=-", "ab1", "a", "'s", "aé́", "😀👍"):
        text = "".join(rnd.choice(alphabet) for _ in range(3000))
        assert tree(coder, text, 100) == library.encode(text, add_special_tokens=False).ids, alphabet


def test_windows_stay_small():
    coder, sizes = bpe.Coder(bpe.vocabulary()), []
    whole, rnd = coder.run, random.Random(9)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    left, right = coder.leaf(text[:10_000]), coder.leaf(text[10_000:])
    coder.run = lambda t: sizes.append(len(t)) or whole(t)
    coder.join(left, right)
    assert sizes and max(sizes) < 1000


def test_rows(spark, rows, library):
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "plain words here", "x" * 500, "".join(rnd.choice(PIECES) for _ in range(400)), "東京" * 300, " ".join("word%d" % i for i in range(400))]
    given = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[5]), (7, "other")]
    got = bpe.digests(rows(*given, more=True).repartition(3), leaf=64)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *by_library(library, t))) for i, t in given)
    assert bpe.digests(rows(*given).where("doc_id < 0")).count() == 0


def test_query_equals_library(spark, library):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op12(spark, path).collect()}
    assert got == {d.doc_id: by_library(library, d.text) for d in docs}
    assert any(len(d.text or "") > bpe.LEAF for d in docs)
