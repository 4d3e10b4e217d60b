"""Python data sources over ORC files: what Spark's own reader does not show."""

from .metadata import ColumnStatistics, FileMeta, RowGroups, Streams, Stripes
from .stripes import StripeScan

SOURCES = (FileMeta, Stripes, ColumnStatistics, Streams, RowGroups, StripeScan)


def register(spark) -> None:
    """Makes the sources known to a session, by the names orc_file_meta, orc_stripes, orc_column_stats, orc_streams,
    orc_row_groups and orc_stripe_scan, and this package to its workers."""
    from ..shipping import ship_package

    ship_package(spark)
    for source in SOURCES:
        spark.dataSource.register(source)
