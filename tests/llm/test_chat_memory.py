"""Packs of the chat trees are read where they are made; words are looked up and give the tokens of the tokenizer."""

import random

from waveloom.llm import chat


def test_packs_are_not_stored_to_be_read_back(spark, sf_dir, monkeypatch):
    rows = chat.op3(spark, sf_dir).collect()
    stored, settle = [], chat.settle

    def noted(df, name="settled"):
        stored.append(name)
        return settle(df, name)

    monkeypatch.setattr(chat, "settle", noted)
    monkeypatch.setattr(chat, "SLICE_BYTES", 1000)
    monkeypatch.setattr(chat, "PACK_CHARS", 3000)
    sliced = chat.op3(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sliced)) and len(rows) > 1
    assert stored == ["conversations"] * chat.MOST_SLICES + ["read-back"] * chat.MOST_SLICES


def test_looked_up_words_have_the_tokens_of_the_tokenizer(monkeypatch):
    monkeypatch.setattr(chat, "WORDS", 2000)
    tokenizer, rng = chat._Tokenizer(chat.vocabulary_text()), random.Random(1)
    assert tokenizer.plain
    pools = ("abzAZ019 \t\n\r'\"!?.,-_\\/éÉßÿĀɏ×÷ªµº\x85\xa0\x1c\x0b\x0c日本²½٣'s'll're  ", "ab '\n\té1!s'lrevmtd", "".join(map(chr, range(32, 0x250))))
    texts = [chat.escape("".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for pool in pools for _ in range(4000)]
    texts += ["<|user|>\n", "<|a\\lb|>\n", chat.END, "</s>[INST]", " long" * 50, " " + "word" * 30]
    for k in range(0, len(texts), 500):
        some = texts[k:k + 500]
        ids = tokenizer.encode(some)
        assert [x.tolist() for x in ids] == [e.ids for e in tokenizer.inner.encode_batch(some, add_special_tokens=False)]
        assert tokenizer.decode(ids) == some
