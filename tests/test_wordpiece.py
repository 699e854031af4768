"""WordPiece against the public implementation, and exact splits."""

import random

import pytest

from lodestack.functions import wordpiece

VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *"abcdefghijklmnopqrstuvwxyz", *[f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"], "the", "tax", "##ation", "##ing", "rul", "law", ",", ".", "-", "(", ")", "中", "文", "1", "##9"]


def test_against_the_public_tokeniser(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = tmp_path / "vocab.txt"
    path.write_text("\n".join(VOCABULARY))
    want = tokenizers.BertWordPieceTokenizer(str(path), lowercase=True, strip_accents=True, clean_text=True, handle_chinese_chars=True)
    made = wordpiece.WordPiece(VOCABULARY)
    rng = random.Random(2)
    texts = ["", "The Taxation ruling, law-ful (Ünïcode) 中文 199", "x" * 120, "tab\tand\nline​", "€ 19 $"]
    texts += ["".join(rng.choice("abcTé 中.,-\n19") for _ in range(60)) for _ in range(50)]
    for t in texts:
        assert made.encode(t) == want.encode(t).ids, t
        assert made.count(t) == len(want.encode(t).ids)
    with pytest.raises(ValueError):
        wordpiece.checked(made.encode("a " * 600))
    with pytest.raises(ValueError):
        wordpiece.WordPiece(["a"])


def test_exact_splits():
    made = wordpiece.WordPiece(VOCABULARY)
    rng = random.Random(5)
    for _ in range(40):
        text = " ".join("".join(rng.choice("abct") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 25)))
        parts = wordpiece.split_exactly(text, made.count, 20)
        assert all(made.count(p) <= 20 for p in parts) and "".join(parts).replace(" ", "") == text.replace(" ", "")
    whole = wordpiece.split_exactly("the law the law the law", made.count, 5)
    assert whole == ["the law the", "law the law"]


def test_table(spark):
    df = spark.createDataFrame([(1, "the law"), (2, None), (3, "a " * 20)], "id long, text string")
    got = {r.id: (r.tokens, r.fits) for r in wordpiece.tokenised(df, "text", VOCABULARY, 10).collect()}
    assert got == {1: (4, True), 2: (2, True), 3: (22, False)}


def test_exact_chunks():
    """No chunk has more tokens than the limit, and nothing is lost."""
    from lodestack.functions import chunking

    count = lambda x: len(x.replace(" ", "")) + 2
    page = "<article><h1>Title</h1>" + "".join(f"<p>{'word' * 30} {'many short words ' * 40}{i}.</p>" for i in range(5)) + "</article>"
    loose = chunking.chunk_html(page)
    tight = chunking.chunk_html(page, count=count, limit=200)
    assert max(count(x) for _, _, x in loose) > 200 >= max(count(x) for _, _, x in tight)
    assert [o for o, _, _ in tight] == list(range(len(tight)))
    assert "".join("".join(x.split()) for _, _, x in tight) == "".join("".join(x.split()) for _, _, x in loose)
