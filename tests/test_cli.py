"""The command line over small files."""

from ledgerloom import cli
from tests.test_sources import BANK


def test_backfill_is_idempotent_and_renders(spark, tmp_path):
    (tmp_path / "bank.csv").write_text(BANK)
    for _ in range(2):
        cli.main(["backfill-bank", f"{tmp_path}/bank.csv", "--log", f"{tmp_path}/log"])
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    spark.sql("select 's' as scope, 'lease' as section, 'end_date' as field, '2025' as value, timestamp'2024-01-01' as ts").write.parquet(f"{tmp_path}/facts")
    cli.main(["render", f"{tmp_path}/facts", "--as-of", "2024-02-01", "--out", f"{tmp_path}/out"])
    assert spark.read.parquet(f"{tmp_path}/out").first().content == "## Lease\n- End date: 2025"
    assert cli.parser().parse_args(["load-master", "x", "--out", "y"]).command == "load-master"
