import uuid

from pyspark.sql import functions as F

from loomlog.functions.ids import NIL, id_key, id_text, key_to_text, uuid5

U = "018efaf0-d925-4826-8aa1-efe73bcedff0"


def test_spellings_are_one_id(spark):
    same = [U, U.upper(), U.replace("-", ""), "{" + U + "}", f"urn:uuid:{U}", f"  {U}\t", f"URN:UUID:{U.upper()}", "(" + U + ")"]
    none = [None, "", "  ", NIL, "0" * 32, "{" + NIL + "}"]
    other = ["evt-1", "29b1e0dc-3268-", "x" * 16, "Ünï", U + "0"]
    df = spark.createDataFrame([(x,) for x in [*same, *none, *other]], "id string").select("id", id_key("id").alias("k"))
    rows = df.select("id", "k", id_text("k").alias("t")).collect()
    assert {r["t"] for r in rows[: len(same)]} == {U}
    assert all(r["k"] is None for r in rows[len(same) : len(same) + len(none)])
    assert [r["t"] for r in rows[-len(other) :]] == other
    assert all(key_to_text(bytes(r["k"])) == r["t"] for r in rows if r["k"] is not None)


def test_uuid5(spark):
    names = ["", "a", "x-y-0", "ü" * 40]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(str(uuid.NAMESPACE_DNS), F.col("n")).alias("u"))
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["n"])) for r in df.collect())
