"""tidyorder: order-aware data cleaning analytics as Spark DataFrame programs."""
