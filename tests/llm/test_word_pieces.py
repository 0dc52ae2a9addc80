import public_tokenizers
from inkveil.llm import packing


def test_plain_words_need_no_expression_and_keep_their_ids(monkeypatch):
    class Never:
        def findall(self, word):
            raise AssertionError(word)

    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    text = "Plain words' no QUITE\x7f unheard, zzqxv' end. a"
    want = tokenizer._whole(text).tolist()
    tokenizer.words.clear()
    monkeypatch.setattr(packing, "PIECE", Never())
    assert tokenizer.known and tokenizer.encode(text).tolist() == want


def test_words_with_marks_equal_the_tokenizer():
    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    words = [a + b for a in ("it", "It'", "A1", "x", "", "don't", "é", "1") for b in (*map(chr, range(33, 128)), "\x00", "'s", "'S", "''", "s'", "1", "é", "…")]
    assert all(tokenizer.encode(w).tolist() == tokenizer._whole(w).tolist() for w in words)


def test_pieces_met_again_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 8)
    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    asked, make = [], tokenizer._piece
    monkeypatch.setattr(tokenizer, "_piece", lambda p: asked.append(p) or make(p))
    tokenizer.pieces.make = tokenizer._piece
    for k in range(200):
        word = f"q{chr(97 + k % 26)}{chr(97 + k // 26)}"
        assert tokenizer.encode(f"always, {word}").tolist() == tokenizer._whole(f"always, {word}").tolist()
    assert asked.count("always") == 1


def test_the_quick_split_of_plain_texts_is_the_tokenizer_files():
    text = "it's O'Re'LL 'S''t 'x 12a3 \xc9t\xe9s***!\x00\x1b\x7f\t a_b-c'\xff " + "".join(map(chr, [*range(1, 28), *range(32, 128), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    assert packing.PLAIN.match(text) and packing.PLAIN_PIECE.findall(text.lower()) == packing.PIECE.findall(text.lower())


def test_workers_keep_no_tokenizer_after_a_task(spark):
    def kept(batches):
        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"n": [len(packing.WordTokenizer._made)]})

    docs = spark.createDataFrame([(i, "some words") for i in range(64)], "doc_id long, text string").repartition(16)
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 64
    assert {r["n"] for r in spark.range(0, 64, 1, 16).mapInPandas(kept, "n int").collect()} == {0}


def test_tidied_steps_give_the_same_batches():
    from inkveil.llm.common import tidy

    assert list(tidy(lambda batches: (2 * x for x in batches))(iter([1, 2, 3]))) == [2, 4, 6]
