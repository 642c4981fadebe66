"""Landing zones as file streams, and stateful operators on event streams."""
