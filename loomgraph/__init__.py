"""Analytics over software-repository graphs and histories, on PySpark."""
