from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.functions.providers import HttpModel, hash_embeddings


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()[0]


def test_strip_takes_unicode_space(spark):
    assert one(spark, T.strip("a"), a="　\xa0 a b \t") == "a b"
    assert one(spark, T.normalize_entity("a"), a=" Chris　 \xa0Evans ") == "chris evans"


def test_clip_adds_dots_only_where_longer(spark):
    assert one(spark, T.clip("a", 3), a="abc ") == "abc"
    assert one(spark, T.clip("a", 3), a="abcd") == "abc..."
    assert one(spark, T.clip("a", 3), a=None) == ""


def test_slice_comes_before_the_filter(spark):
    df = spark.createDataFrame([([" ", "a", None, "b"],)], "t array<string>")
    assert df.select(T.join_first("t", 3, 99)).first()[0] == "a"
    assert df.select(T.snippets("t", 2)).first()[0] == "- a"


def test_scores_have_to_be_plain_numbers(spark):
    raw = ["0", "1.0", "0.5", ".5", "1.2", "abc", "", " 1 ", "0.", None]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(T.parse_score("r")).collect()
    assert [g[0] for g in got] == [0.0, 1.0, 0.5, None, None, None, None, 1.0, None, None]


@given(st.text(alphabet='{}"\\ab, ', max_size=30))
def test_first_json_object_is_balanced(raw):
    found = T.first_json_object(raw)
    assert found is None or (found[0] == "{" and found[-1] == "}" and found in raw)


def test_first_json_object_skips_fences_and_quoted_braces():
    assert T.first_json_object('```json {"a": "}\\"{"} ``` {}') == '{"a": "}\\"{"}'
    assert T.first_json_object("{ open { {}") == "{}"
    assert T.first_json_object(None) is None


def test_zero_vector_has_a_norm(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r[0] for r in df.select(V.norm(F.col("v"))).collect()] == [1e-10, 5.0]


def test_hash_embeddings_are_unit_or_zero(spark):
    df = spark.createDataFrame([(1, "Alpha beta"), (2, ""), (3, None)], "k long, t string")
    got = {r.k: r.vec for r in hash_embeddings(df, "k", "t").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and not any(got[2]) and not any(got[3])


def test_http_model_sends_prompts(spark):
    def echo(url, body, timeout):
        return {"response": f"{body['model']}:{body['prompt'].upper()}:{body['options']['temperature']}"}

    df = spark.createDataFrame([(1, "hi")], "k long, t string")
    got = HttpModel("http://nowhere", "m", transport=echo).complete(df, F.col("t")).first()
    assert got.response == "m:HI:0.0" and got.k == 1
