"""weftwork: declarative warehouse-ETL operators and ETL metadata analytics on Spark."""
