"""Query plans over the driver's tables: each registered query is a function
``(spark, sf_dir) -> DataFrame`` with an equivalent SQL text for an external
engine, and the end-to-end augmentation flow."""
