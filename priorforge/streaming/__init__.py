"""Nothing streams: the library's only incremental behaviour is resuming unfinished cells (plans.experiment) and replacing results by method (sources.files)."""
