"""Scratch tables start few processes: they have no checksum files."""

from pathlib import Path

from lodestone.sources.store import discard, materialize


def test_stored_tables_have_no_checksum_files(spark):
    table = materialize(spark.range(0, 100, 1, 5).selectExpr("id", "cast(id as string) as name"), "plain")
    at = Path(table._stored_at.removeprefix("file://"))
    assert len([*at.glob("*.parquet")]) == 5 and (at / "_SUCCESS").exists()
    assert not [*at.rglob("*.crc")]
    assert table.count() == 100 and table.agg({"id": "sum"}).first()[0] == 4950
    discard(table)
    assert not at.exists()
