"""Details are worked out once for a pair of texts and are those of every row."""

from pyspark.sql import functions as F

from tallymark.operators import scoring


def test_details_by_text_are_those_of_rows(spark):
    texts = [("답은 16 입니다", "16"), ("첫째, 값을 추정\n결과는 3,5", "합계 3,5개"), (None, "16"), ("아마 7 km", None), (None, None), ("", "")]
    rows = spark.createDataFrame([(i, *texts[i % 6]) for i in range(60)], "id long, prediction string, truth string")
    want = scoring.with_details(rows, "korean_math")
    got = scoring.with_details_by_text(rows, "korean_math").select(want.columns)
    assert got.count() == 60
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_row_works_its_steps_out_once(spark):
    rows = spark.createDataFrame([("답은 16 입니다", "16")], "prediction string, truth string")
    plan = scoring.with_details(rows, "korean_math").select(F.struct("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(prediction") == 1
