"""Job-posting intelligence as DataFrame-to-DataFrame operators on Spark."""
