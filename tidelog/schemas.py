"""Row types of logs, catalogs and histories."""

OP_LOG = "seq BIGINT, op STRING, key STRING, value STRING"
MANIFEST = "file_id BIGINT, level INT, file_size BIGINT, smallest STRING, largest STRING"
RAFT_LOG = "term BIGINT, idx BIGINT, op STRING, key STRING, value STRING"
HISTORY = "op STRING, key STRING, value STRING, start_us BIGINT, end_us BIGINT, success BOOLEAN, result STRING, client_id BIGINT, seq BIGINT"
METRIC = "node STRING, ts TIMESTAMP, name STRING, value DOUBLE"
SNAPSHOT_META = "last_included_index BIGINT, last_included_term BIGINT, file_count BIGINT, total_size BIGINT"
SWEEP = "config STRING, memtable_kb INT, block_size INT, bloom_bits INT, write_ops_per_sec BIGINT, read_ops_per_sec BIGINT, write_time_sec DOUBLE, read_time_sec DOUBLE, read_hits BIGINT, read_misses BIGINT, scan_count BIGINT, verify_errors BIGINT, status STRING"

# Engine options and their defaults.
MEMTABLE_BYTES = 256 * 1024
L0_FILE_LIMIT = 2
MAX_LEVELS = 7
L1_BYTES = 10 * 1024 * 1024
SCAN_COUNT_DEFAULT, SCAN_COUNT_MAX = 10, 1000
RAFT_SNAPSHOT_ENTRIES, RAFT_SNAPSHOT_BYTES = 10_000, 20 * 1024 * 1024
REPL_BATCH = 128
CHUNK_BYTES = 512 * 1024
VNODES = 150
