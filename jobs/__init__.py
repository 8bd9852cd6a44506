"""Jobs to run from a shell or a scheduler: `python -m jobs.clone_review --help`, `python -m jobs.reference_index --help`."""
