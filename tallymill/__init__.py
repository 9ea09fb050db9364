"""Message-to-ledger analytics as PySpark DataFrame jobs."""
