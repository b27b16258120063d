"""Operations of a training-data pipeline: ten operators, each a Spark job.

Nothing outside this subpackage imports it.
"""
