"""PySpark toolkit for rain-recording tables: curate, balance, measure, select, train, evaluate."""
