"""clausewright: text-retrieval evaluation analytics on PySpark DataFrames."""
