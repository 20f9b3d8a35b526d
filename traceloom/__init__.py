"""traceloom: analytics over desktop activity stores, declared as Spark plans."""
