"""Column -> Column builders; everything here stays inside Spark expressions unless it says otherwise."""
