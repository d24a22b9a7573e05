from __future__ import annotations

import pandas as pd
import pytest
from conftest import rows

from tallybird.operators.quality import key_violations, orphan_reviews, valid_reviews
from tallybird.plans.warehouse import load_star_schema, star_table
from tallybird.operators.cleaning import clean_all
from tallybird.schemas import RAW, STAR
from tallybird.sources import quarantine
from tallybird.sources.landing import load_raw, read_raw, read_raw_text, require_valid, validation_report
from tallybird.sources.retail_views import raw_tables
from tallybird.sources.sinks import append_if_empty, conform, export_csv, replace_table
from tallybird.sources.workspace import fingerprint, shared_folder


def _write(folder, table, text):
    (folder / f"{table}.csv").write_text(text)


def test_columns_are_read_by_name(spark, tmp_path):
    _write(
        tmp_path, "products",
        "extra,inventory,product_id,category,brand,cost,selling_price\nx,,1,  Toys ,B,1.5,2\n",
    )
    row = require_valid(read_raw(spark, str(tmp_path), "products"), "products").first()
    assert (row["product_id"], row["category"], row["inventory"]) == (1, "  Toys ", None)
    assert row["extra"] == "x"


def test_validation_errors(spark, tmp_path):
    header = ",".join(RAW["orders"].names)
    _write(tmp_path, "orders", header + "\n")
    _write(tmp_path, "reviews", "review_id,rating\n1,5\n")
    with pytest.raises(FileNotFoundError):
        read_raw(spark, str(tmp_path), "customers")
    with pytest.raises(ValueError, match="no rows"):
        require_valid(read_raw(spark, str(tmp_path), "orders"), "orders")
    with pytest.raises(ValueError, match="order_id"):
        require_valid(read_raw(spark, str(tmp_path), "reviews"), "reviews")
    frames = {t: read_raw(spark, str(tmp_path), t) for t in ("orders", "reviews")}
    report = {r["table_name"]: r for r in validation_report(frames).collect()}
    assert report["orders"]["status"] == "empty"
    assert report["reviews"]["status"] == "missing columns"
    assert report["reviews"]["missing_columns"].startswith("customer_id, order_id")


def test_csv_round_trip_keeps_spaces_and_nulls(spark, data_dir, tmp_path):
    for name, df in raw_tables(spark, data_dir).items():
        export_csv(df, f"{tmp_path}/{name}.csv")
        assert rows(read_raw(spark, str(tmp_path), name)) == rows(df)
    assert set(load_raw(spark, str(tmp_path))) == set(RAW)


def test_append_only_once(spark, tmp_path):
    df = spark.range(5)
    target = f"{tmp_path}/t"
    first, second = (append_if_empty(spark, df, target) for _ in range(2))
    assert first.appended and not second.appended
    assert second.rows_before == 5
    assert spark.read.parquet(target).count() == 5


def test_append_to_an_existing_empty_table(spark, tmp_path):
    target = f"{tmp_path}/t"
    spark.range(0).write.parquet(target)
    assert append_if_empty(spark, spark.range(3), target).appended
    assert spark.read.parquet(target).count() == 3


def test_replace_leaves_only_the_new_rows(spark, tmp_path):
    target = f"{tmp_path}/t"
    replace_table(spark.range(9), target)
    assert replace_table(spark.range(2), target).count() == 2


def test_load_can_be_repeated(spark, data_dir, tmp_path):
    clean = clean_all(raw_tables(spark, data_dir))
    first = rows(load_star_schema(spark, clean, str(tmp_path)))
    assert rows(load_star_schema(spark, clean, str(tmp_path))) == first
    for name, schema in STAR.items():
        assert star_table(spark, str(tmp_path), name).columns == schema.names


def test_conform_rounds(spark):
    df = spark.sql("SELECT 33.5D AS age, 2.5D AS other").withColumnRenamed("other", "tenure_days")
    schema = type(STAR["customers"])(
        [f for f in STAR["customers"] if f.name in ("age", "tenure_days")]
    )
    assert rows(conform(df, schema)) == [(34, 2)]


def test_reviews_of_unknown_orders(spark):
    reviews = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "review_id int, order_id int")
    orders = spark.createDataFrame([(10,)], "order_id int")
    assert rows(valid_reviews(reviews, orders)) == [(1, 10)]
    assert rows(orphan_reviews(reviews, orders)) == [(2, 11), (3, None)]


def test_key_violations_count_rows_behind_a_hot_orphan(spark):
    def table(name, data):
        return spark.createDataFrame(data, RAW[name])

    order = (1, 7, None, "2024-01-01", 1, 1.0, 0.0, "COD", 1, "Delivered")
    tables = {
        "customers": table("customers", [(1, "a", 1, "m", "c", "2024-01-01", "s")] * 2),
        "products": table("products", []),
        "orders": table("orders", [order] * 50),
        "reviews": table("reviews", [(None, None, 1, 5, "t", "2024-01-01")]),
        "marketing": table("marketing", [(1, 1, "c", 1.0, 1, 0)]),
    }
    found = dict(rows(key_violations(tables)))
    assert found["customers.customer_id duplicate"] == 1
    assert found["orders.customer_id orphan"] == 50
    assert found["orders.product_id orphan"] == 0  # NULL is allowed
    assert found["reviews.review_id null"] == 1
    assert found["reviews.customer_id orphan"] == 0


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_fingerprint_follows_the_files(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    before = fingerprint(spark, str(tmp_path))
    (tmp_path / "b").write_text("22")
    assert fingerprint(spark, str(tmp_path)) != before


def test_files_as_other_tools_write_them(spark, tmp_path):
    """Whole numbers with a fraction, words among numbers, line breaks in a quoted text."""
    _write(
        tmp_path,
        "customers",
        "customer_id,customer_name,age,gender,city,signup_date,customer_segment\n"
        '1,Ann,34.0,F,"Two\nlines",2020-01-01,A\n2,Bob,,M,x,2020-01-01,B\n3,Cem,abc,M,x,2020-01-01,B\n,Dee,41.5,F,x,,C\n',
    )
    typed = {r["customer_name"]: r for r in read_raw(spark, str(tmp_path), "customers").collect()}
    found = pd.read_csv(f"{tmp_path}/customers.csv")
    assert len(typed) == len(found) == 4
    assert [typed[n]["age"] for n in ("Ann", "Bob", "Cem", "Dee")] == [34, None, None, None]
    assert typed["Ann"]["city"] == found["city"][0] == "Two\nlines"
    texts = read_raw_text(spark, str(tmp_path), "customers")
    report = validation_report({"customers": texts}).first()
    assert (report["n_rows"], report["n_bad_values"], report["n_null_keys"]) == (4, 2, 1)
    assert report["status"] == "bad values"
    with pytest.raises(ValueError, match="2 values"):
        require_valid(texts, "customers")


def test_parts_with_different_headers_are_an_error(spark, tmp_path):
    folder = tmp_path / "marketing.csv"
    folder.mkdir()
    names = RAW["marketing"].names
    (folder / "part-0.csv").write_text(",".join(names) + "\n1,2,x,3,4,5\n")
    swapped = [names[1], names[0], *names[2:]]
    (folder / "part-1.csv").write_text(",".join(swapped) + "\n2,1,x,3,4,5\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_raw(spark, str(tmp_path), "marketing").collect()


def test_a_load_that_did_not_end_is_done_again(spark, tmp_path):
    target = tmp_path / "t"
    spark.range(5).write.parquet(str(target))
    (target / "_SUCCESS").unlink()
    assert append_if_empty(spark, spark.range(3), str(target)).appended
    assert spark.read.parquet(str(target)).count() == 3


def test_fingerprint_sees_files_inside_a_table_folder(spark, tmp_path):
    (tmp_path / "t.parquet").mkdir()
    (tmp_path / "t.parquet" / "part").write_text("a")
    before = fingerprint(spark, str(tmp_path))
    (tmp_path / "t.parquet" / "part").write_text("bb")
    assert fingerprint(spark, str(tmp_path)) != before


def test_bad_records_are_kept_with_file_reasons_and_text(spark, tmp_path):
    folder = tmp_path / "products.csv"
    folder.mkdir()
    header = "product_id,category,brand,cost,selling_price,inventory,note\n"
    (folder / "a.csv").write_text(header + '1,Toys,B,1.5,2,34.0,"two\nlines"\n,Toys,B,x1,2,,\n3,,,,,,\n')
    (folder / "b.csv").write_text(header + "4,Toys,B,1,2\n5,Toys,B,1,2,3,n,extra\n6,Toys,B,1,2,many,n\n1,Toys,B,1.5,2,34.0,\n")
    quarantine.split_raw(spark, str(folder), "products", f"{tmp_path}/out")
    good = quarantine.accepted(spark, f"{tmp_path}/out", "products")
    assert [f.dataType for f in good.schema][:6] == [f.dataType for f in RAW["products"]]
    assert rows(good.select("product_id", "inventory", "note")) == [(1, 34, "two\nlines"), (1, 34, None), (3, None, None)]
    bad = quarantine.rejected(spark, f"{tmp_path}/out", "products").collect()
    found = sorted((r["file"].rsplit("/", 1)[1], tuple(r["reasons"])) for r in bad)
    assert found == [
        ("a.csv", ("bad value: cost", "no key: product_id")), ("b.csv", ("bad value: inventory",)),
        ("b.csv", ("wrong number of fields",)), ("b.csv", ("wrong number of fields",)),
    ]
    texts = " ".join(r["record"] for r in bad)
    assert "5,Toys,B,1,2,3,n,extra" in texts and '"cost":"x1"' in texts and '"product_id":null' in texts
    report = dict(rows(quarantine.quarantine_report(spark, f"{tmp_path}/out", "products")))
    assert (report["all"], report["accepted"], report["rejected"], report["wrong number of fields"]) == (7, 3, 4, 2)
    # a second delivery takes the place of the first; nothing but a header, and columns that are missing or reserved
    (folder / "a.csv").write_text(header)
    (folder / "b.csv").unlink()
    quarantine.split_raw(spark, str(folder), "products", f"{tmp_path}/out")
    assert quarantine.accepted(spark, f"{tmp_path}/out", "products").count() == 0
    assert quarantine.rejected(spark, f"{tmp_path}/out", "products").count() == 0
    assert dict(rows(quarantine.quarantine_report(spark, f"{tmp_path}/out", "products"))) == {"all": 0, "accepted": 0, "rejected": 0}
    (tmp_path / "other.csv").write_text("product_id\n1\n")
    with pytest.raises(ValueError, match="category"):
        quarantine.judged_raw(spark, f"{tmp_path}/other.csv", "products")
    (tmp_path / "clash.csv").write_text(header.replace("note", "_file") + "1,,,,,,x\n")
    with pytest.raises(ValueError, match="_file"):
        quarantine.judged_raw(spark, f"{tmp_path}/clash.csv", "products")
