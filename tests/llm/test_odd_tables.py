"""The queries over documents, with null, empty, long and repeated rows and with columns that clash with those inside operators."""

import random

import pytest
from siftline.llm import queries

WORDS = "the of and to in der die und ist le la et les under mit license password access token river stone".split()
CLASH = (
    "row row_id id part rank length block score spans n h key task own node root set_hash bands sketch words start piece offset sequence_id "
    "held_out lang_pred n_tokens n_known n_words labels matches payload media word count total at home source_size doc __id __text __n class_id kept"
).split()
#: For each query, its columns that may differ between runs.
OPERATORS = {
    "op1_media_webp": (),
    "op3_secret_scan": (),
    "op4_language_id": (),
    "op5_bpe_codec": (),
    "op6_best_two_fit": ("sequence_id", "offset"),
    "op8_near_dedup": ("kept",),
    "op9_license_scan": (),
    "op10_lm_score": (),
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.choice([3, 40, 200]))), rng.choice(["en", "de", "fr", None]), "web", 1) for i in range(60)]
    rows += [(60, None, "en", None, None), (61, "", None, None, None), (62, " \n", "de", "a", 0), (None, "the river and the stone", None, None, None), (63, "12 !", None, "a", 4)]
    rows += [(64, "under the mit license token=abcdef123456 " * 3000, "en", "a", 0), rows[5], rows[5], (65, rows[5][1], "fr", "b", 0), (66, "é ß 河́ \U0001f600", "de", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, one in (("plain", df), ("clash", df.selectExpr("*", *(f"'?' AS `{c}`" for c in CLASH))), ("empty", df.limit(0))):
        out[name] = str(tmp_path_factory.mktemp(name))
        one.write.parquet(f"{out[name]}/documents.parquet")
    return out


def rows_of(df, but):
    columns = sorted(set(df.columns) - set(but))
    return sorted(([round(v, 4) if isinstance(v, float) else v for v in (r[c] for c in columns)] for r in df.collect()), key=repr), columns


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_play_no_part(spark, folders, name):
    plain, clash = (rows_of(queries.QUERIES[name](spark, folders[x]), OPERATORS[name]) for x in ("plain", "clash"))
    assert plain == clash
    documents = spark.read.parquet(f"{folders['plain']}/documents.parquet")
    per_row = len(plain[0]) if name != "op6_best_two_fit" else sum(r[plain[1].index("piece")] == 0 for r in plain[0])
    assert per_row == documents.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, folders, name):
    assert queries.QUERIES[name](spark, folders["empty"]).count() == 0
