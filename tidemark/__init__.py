"""Code-change and similarity analytics on Spark: column-parameterised DataFrame kernels."""
