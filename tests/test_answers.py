"""Answers of the review are saved, used again, and asked for again where there was none."""

from flowtide.operators import review
from flowtide.session import new_table_path

REPORT = "id string, report string"


def answer(title, silent=()):
    return lambda: lambda text: {} if text in silent else {"vulnerable": text.startswith("bad"), "vulnerability_type": title, "facts": [text]}


def rows(frame):
    return sorted((r.id, r.vulnerable, r.vulnerability_type) for r in frame.collect())


def test_saved_and_used_again(spark):
    folder = new_table_path(spark, "answers")
    reports = spark.createDataFrame([("a", "bad 1"), ("b", "bad 1"), ("c", "fine"), ("d", "odd"), ("e", None), ("f", "")], REPORT)
    first = rows(review.ask_saving(reports, answer("one", {"odd"}), folder))
    assert first == [("a", True, "one"), ("b", True, "one"), ("c", False, "one"), ("d", None, None), ("f", False, "one")]
    assert review.saved_answers(spark, folder).count() == 3  # equal reports once, no answer not at all
    again = rows(review.ask_saving(reports, answer("two"), folder))
    assert again == [r if r[0] != "d" else ("d", False, "two") for r in first]
    # Another model or temperature has answers of its own.
    other = rows(review.ask_saving(reports.where("id = 'a'"), answer("three"), folder, "large", 0.5))
    assert other == [("a", True, "three")]
    assert rows(review.ask_saving(reports.where("id = 'a'"), answer("four"), folder)) == [("a", True, "one")]


def test_two_jobs_saved_the_same_key(spark):
    folder = new_table_path(spark, "answers")
    reports = spark.createDataFrame([("a", "bad")], REPORT)
    review.ask_saving(reports, answer("one"), folder)
    spark.read.parquet(folder).write.mode("append").parquet(folder)
    assert rows(review.ask_saving(reports, answer("two"), folder)) == [("a", True, "one")]


def test_empty(spark):
    folder = new_table_path(spark, "answers")
    assert review.ask_saving(spark.createDataFrame([], REPORT), answer("one"), folder).isEmpty()
