"""convseries: series features, group ensembles and prediction-table analytics on Spark."""
