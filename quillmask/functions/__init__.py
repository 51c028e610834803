"""Expression builders: array folds, span search, span algebra and redaction.

All of them take and return Spark SQL expression text. A stage of the pipeline
is one ``F.expr`` over that text: the JVM parses it at once, where building the
same nested lambdas through the Column API costs thousands of driver calls and
seconds per column. Column names passed in must differ from the one- and
two-letter lambda variables; the pipeline's own columns do.
"""
