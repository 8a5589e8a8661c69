from __future__ import annotations

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use inside
    "rid string, name string, h int, idx int, key string, node string, score string, predicted string, "
    "__id string, __key string, __n string, __leaf string, tokens string, kept string, n_tokens string, cid string, g string"
)
LONG = "wörter und zahlen 12345, it's we'll don't  \n\t" * 4000


def row(doc_id, text, lang="en", source="src1"):
    return (doc_id, text, lang, source, len(text or ""), *["x"] * 2, 1, 2, *["y"] * 13)


#: Nulls in every column that an operator reads, empty and blank and very long texts, ties and repeated rows.
ROWS = [
    row(1, "the quick brown fox jumps over the lazy dog and runs away from it all"),
    row(2, "The Quick Brown Fox jumps over the lazy dog and runs away from it all"),
    row(3, None),
    row(4, ""),
    row(5, " \n\t "),
    row(6, LONG),
    row(7, LONG),
    row(8, "four words are here"),
    row(8, "four words are here"),
    row(8, "another text with the same id as two others"),
    row(None, "a row without an id has this text"),
    row(None, None, None, None),
    row(9, "ÄÖÜ äöü É é ß İ ſ K ǅ", "de", None),
    row(10, "äÖÜ äöü É é ß İ ſ K ǅ", None, "src2"),
    row(11, "日本語のテキスト 😀 mixed with <|endoftext|> and \x00\x1f\x85\xa0 odd characters", "en", "other"),
    row(-5, "a negative id\r\nLicensed under the Apache License, Version 2.0.\nend", "fr", "src22"),
]


@pytest.fixture(scope="session")
def shipped(spark):
    from normlearn.llm.ship import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def edge_docs(shipped, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    shipped.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    return shipped.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(shipped, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    shipped.createDataFrame([], SCHEMA).write.parquet(path)
    return shipped.read.parquet(path)


@pytest.fixture(scope="session")
def documents(shipped, sf_dir):
    return shipped.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
