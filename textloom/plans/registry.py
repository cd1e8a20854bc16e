"""All registered queries of the engine with their DuckDB SQL."""

from textloom.plans import analysis, corpus, evaluation

QUERIES: dict = corpus.R.queries | evaluation.R.queries | analysis.R.queries
ORACLE: dict = corpus.R.oracle | evaluation.R.oracle | analysis.R.oracle
