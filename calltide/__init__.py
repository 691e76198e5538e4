"""calltide: analytics over call logs, evaluation results and semi-structured documents, on PySpark."""
