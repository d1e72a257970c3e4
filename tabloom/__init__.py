"""tabloom: tabular features, histograms and model evaluation as Spark jobs."""
