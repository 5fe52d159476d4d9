"""Rules, workflows and metadata: what is decided on the driver."""
