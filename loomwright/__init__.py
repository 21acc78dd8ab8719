"""loomwright: a Spark-native data-activation engine (catalog, query, flow, search and streaming operators)."""
