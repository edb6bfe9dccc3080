"""p3: which files each update run had to process."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import step
from ..session import shared_dir, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "scan_runs").where("kind = 'update_project' AND status = 'COMPLETED'")
    real = ~F.col("file_path").startswith("vfs://")
    scans = table(spark, d, "file_scans").where(real)
    base = table(spark, d, "file_metadata").where(real)
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    return step(path, runs, scans, base, "project_id", "job_id", "created_at", ["file_path"], "arrived_at", "observed_at", "scan_id", "content_hash")


QUERIES = {"p3_found": p3_found}

ORACLE = {
    "p3_found": """
WITH r AS (SELECT DISTINCT project_id, job_id, created_at FROM scan_runs WHERE kind = 'update_project' AND status = 'COMPLETED'),
rr AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, job_id) AS nth FROM r),
m AS (SELECT project_id, file_path, max(content_hash) AS h FROM file_metadata WHERE file_path NOT LIKE 'vfs://%' GROUP BY 1, 2),
f AS (SELECT project_id, file_path FROM m UNION SELECT project_id, file_path FROM file_scans WHERE file_path NOT LIKE 'vfs://%'),
seen AS (SELECT rr.project_id, rr.job_id, rr.nth, f.file_path, coalesce(
    (SELECT arg_max(s.content_hash, (s.observed_at, s.scan_id)) FROM file_scans s WHERE s.project_id = f.project_id AND s.file_path = f.file_path
      AND s.arrived_at <= rr.created_at AND s.content_hash IS NOT NULL), m.h) AS h, m.h AS start
  FROM rr JOIN f ON f.project_id = rr.project_id LEFT JOIN m ON m.project_id = f.project_id AND m.file_path = f.file_path),
p AS (SELECT *, CASE WHEN nth = 1 THEN start ELSE lag(h) OVER (PARTITION BY project_id, file_path ORDER BY nth) END AS prior FROM seen)
SELECT job_id, project_id, file_path FROM p WHERE h IS NOT NULL AND h IS DISTINCT FROM prior""",
}
