"""Tables over JDBC, with the embedded database that Spark brings along."""

from palimpsest.operators import mask, validate
from palimpsest.operators.mask import ColumnPlan
from palimpsest.operators.validate import TableMeta
from palimpsest.sources import catalog as sources

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_a_table_over_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(k, f"source{k}@example.test", None if k % 5 == 0 else f"note {k}") for k in range(60)], "ID int, EMAIL string, NOTES string")
    rows.write.format("jdbc").options(url=url, dbtable="CONTACTS", driver=DRIVER).save()
    split = {"partitionColumn": "ID", "lowerBound": "0", "upperBound": "60", "numPartitions": "4"}
    read = lambda: sources.read_jdbc(spark, url, "CONTACTS", driver=DRIVER, **split)
    catalog = sources.Catalog(spark, str(tmp_path / "nothing"), {"contacts": TableMeta(keys=["ID"])}, {"contacts": read})
    assert catalog.tables() == ["contacts"] and catalog.keys("contacts") == ["ID"] and catalog.key_holds("contacts")
    df = catalog.table("contacts")
    assert df.rdd.getNumPartitions() == 4 and sorted(map(tuple, df.collect())) == sorted(map(tuple, rows.collect()))
    # A predicate on the key goes to the database.
    assert "*GreaterThan(ID,50)" in df.where("ID > 50")._jdf.queryExecution().toString() and catalog.page("contacts", 5, after=(54,)).count() == 5
    result = mask.apply(df, [ColumnPlan("email", "fake_email")], ["ID"], "s", str(tmp_path / "masked"))
    assert result.rows == 60 and result.columns == ["EMAIL"]
    found = validate.completeness(df, spark.read.parquet(str(tmp_path / "masked")), ["ID"], ["EMAIL"]).first()
    assert (found["status"], found["compared"], found["unmasked"]) == ("pass", 60, 0)
