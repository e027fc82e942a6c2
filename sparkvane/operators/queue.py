"""State transitions of a leased job queue, as functions of the job table.

The compare-and-set of a claim belongs to the database that holds the table (``sources.tables``
reads and writes it over JDBC); these functions give the rows before and after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: states of a job
DRAFT, QUEUED, RUNNING, REVIEW, PARTIAL, WAITING, FAILED, CUT, CANCELLED = (
    "Taslak",
    "Sırada",
    "Araştırılıyor",
    "İnceleme bekliyor",
    "Kısmen tamamlandı",
    "Kaynak bekliyor",
    "Hata",
    "Kesildi",
    "İptal edildi",
)
LEASE_SECONDS = 180


def _set(df: DataFrame, when: Column, **values) -> DataFrame:
    return df.withColumns({c: F.when(when, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def expire(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease has run out are cut."""
    gone = (F.col("status") == RUNNING) & (F.col("lease_until") < now)
    return _set(jobs, gone, status=CUT)


def next_queued(jobs: DataFrame) -> DataFrame:
    """The oldest queued job (at most one row)."""
    return jobs.where(F.col("status") == QUEUED).orderBy("created_at", "id").limit(1)


def claim(jobs: DataFrame, job_id, token: str, now: Column) -> DataFrame:
    """The job runs under the token, if it is queued; otherwise nothing changes."""
    hit = (F.col("id") == job_id) & (F.col("status") == QUEUED)
    return _set(jobs, hit, worker_token=token, lease_until=now + LEASE_SECONDS, status=RUNNING)


def heartbeat(jobs: DataFrame, job_id, token: str, now: Column) -> DataFrame:
    """A longer lease, for the holder of a lease that has not run out."""
    return _set(jobs, _held(job_id, token, now), lease_until=now + LEASE_SECONDS)


def _held(job_id, token: str, now: Column) -> Column:
    return (F.col("id") == job_id) & (F.col("worker_token") == token) & (F.col("status") == RUNNING) & (F.col("lease_until") >= now)


def update(jobs: DataFrame, job_id, token: str, now: Column, **values) -> DataFrame:
    """A guarded write: only the holder of a live lease changes a job; cancelled jobs stay cancelled."""
    return _set(jobs, _held(job_id, token, now), **values)


def cancel(jobs: DataFrame, job_id) -> DataFrame:
    return _set(jobs, (F.col("id") == job_id) & ~F.col("status").isin(REVIEW, PARTIAL, FAILED), status=CANCELLED)


def newest(jobs: DataFrame, k: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(k)
