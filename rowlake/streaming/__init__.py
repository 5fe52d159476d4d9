"""Event-time windows, state and delivery guarantees."""
