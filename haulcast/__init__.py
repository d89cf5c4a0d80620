"""haulcast: vehicle-telematics trip and arrival-time analytics on Spark DataFrames."""
