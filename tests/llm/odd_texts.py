"""Odd inputs and helpers shared by these tests."""

#: Texts that break careless code: empty, blank, repeated, odd white space, special strings, one endless word.
ODD = [
    None, "", " ", "  two  spaces ", "a\n b \n\nc\t\td", "a <|endoftext|> b<|startoftext|>", "don't I'LL x's", "a" * 3000,
    "é ́a  Å ﬁ ½ 日本語 한국어 ΣΑΣ İ", "x\x1cy\x85z w", "the same line\nthe same line\nthe same line", "the same line\nthe same line\nthe same line",
]


def save(spark, tmp_path, **tables):
    """A folder of tables, as the queries read them."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
