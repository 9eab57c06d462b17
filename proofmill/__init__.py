"""Document QA and corpus profiling as Spark DataFrame operators."""
