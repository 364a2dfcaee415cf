"""Tidewater: analytics, ETL and corpus operators over the public Spark DataFrame API."""
