"""DataFrame operators over change logs: ordering, schemas, GTID sets, checkpoints, audits."""
