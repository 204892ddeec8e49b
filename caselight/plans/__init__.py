"""From raw tables to the published case model."""
