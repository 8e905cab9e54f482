"""DataFrame operators: join paths, retrieval, de-duplication, profiling, evaluation."""
