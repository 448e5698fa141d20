"""mercato: marketplace star-schema analytics as Spark DataFrame jobs.

Layout
------
sources/    schemas, CSV ingestion, table catalog, test-table adapter
functions/  exact decimal arithmetic on columns, fixed report labels
operators/  reusable relational building blocks (shares, ranking, tiling)
plans/      the report jobs (profiling, sales, operations, experience,
            quality, metrics) and the job registry
streaming/  incremental (file-stream) variant of the CSV load

Every job takes a ``dict[str, DataFrame]`` of the nine star tables and
returns one lazy DataFrame; nothing is collected to the driver.
"""

from mercato.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
