"""paperloom: record audit, flattening and text preparation as Spark DataFrame plans."""
