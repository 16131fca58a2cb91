from ndspark.plans import catalog


def test_the_whole_array_goes_over_http_and_is_appended(spark):
    sf = "/root/testdata/sf0.01"
    vectors, events = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("embeddings", "events"))
    first = catalog._over_http(spark, sf)
    most = vectors.agg({"vec_id": "max"}).first()[0]
    assert first.shape[0] == most + 1 > 200 and first.df.where(f"d0 = {most}").count() == first.shape[1]
    n = events.agg({"event_id": "max"}).first()[0] + 1
    assert n > 700 and catalog.QUERIES["stored_append_whole"](spark, sf).where(f"d0 >= {n + 700}").count() == n - 700
