"""No stream is read here: input arrives as files, and ``sources.ingest`` replaces them one by one."""
