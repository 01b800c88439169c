"""Settings that fit a cluster to an input."""

from __future__ import annotations


def settings(input_bytes: int, cores: int, executor_memory_bytes: int, shared: str) -> dict[str, str]:
    """Spark settings for an input of so many (compressed) bytes on so many cores.

    Shuffle partitions hold about 128 MB of input each, with two to fifty for each core; adaptive
    execution joins small ones and splits hot ones. Scans take pieces that leave a core's share of memory
    room for the text unpacked (about five times the file) and for Arrow batches, which are limited
    in bytes since a text may be long.
    """
    share = executor_memory_bytes // max(1, cores)
    piece = max(16 << 20, min(128 << 20, share // 16))
    return {
        "spark.checkpoint.dir": shared,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(max(2 * cores, min(50 * cores, -(-input_bytes // (128 << 20))))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(64 << 20),
        "spark.sql.files.maxPartitionBytes": str(piece),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    }
