"""weftline: text-pair curation and analytics on PySpark."""
