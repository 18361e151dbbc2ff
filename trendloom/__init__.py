"""Panel forecasting, customer value, interaction graphs and text labels as Spark DataFrame jobs."""
