"""Source listing, incremental snapshots, the TypeScript/JavaScript front end, YAML and JSONL readers."""
