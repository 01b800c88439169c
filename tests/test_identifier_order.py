from bindery.plans.entry_queries import identifier_order_by_value


def test_roman_numbers_by_value(spark, tmp_path):
    names = ["XIX", "b", "IX", "10", "V", "XV", "9", "Appendix", "x", ""]
    rows = [(f"b:{i}", n, "z") for i, n in enumerate(names)]
    spark.createDataFrame(rows, "unique_key string, entry_number string, entry_id string").write.parquet(str(tmp_path / "chapter.parquet"))
    place = {r["unique_key"]: r["place"] for r in identifier_order_by_value(spark, str(tmp_path)).collect()}
    assert [names[int(k[2:])] for k in sorted(place, key=place.get)] == ["9", "10", "V", "IX", "x", "XV", "XIX", "Appendix", "b", ""]
