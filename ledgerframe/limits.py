"""Bounds and reserved values. These are fixed values of the data model."""

EARLIEST = 0
LATEST = -1
FIRST_OFFSET = 1
OFFSET, TS = "ledger_offset", "ledger_ts"
MAX_REPLAY = 100_000
MAX_TAIL = 1_000_000
GROUP_ROWS = 10_000
DEDUPE_WINDOW = 64
KEEP_VERSIONS = 10
RETENTION_GRACE_US = 3_600_000_000
RESTORE_RESERVE = 1 << 20
RESTORE_RESERVE_PUBLISHED = 1 << 40
MAX_IN_FLIGHT = 64
MAX_BACKLOG = 8_192
BATCH_LIMIT = 500
PAGE_BYTES, PAGE_ROWS = 16 << 20, 50_000  # of a page that the driver holds
