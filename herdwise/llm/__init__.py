"""Training-data operators: text in, text or verdicts out, each as a Spark job.

Nothing outside this subpackage imports it.
"""
