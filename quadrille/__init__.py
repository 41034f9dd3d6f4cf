"""quadrille: spatial tile analytics and corpus preparation on Spark DataFrames."""
