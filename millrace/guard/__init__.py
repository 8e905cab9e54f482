"""The SQL guard: rules over parsed statements and the declared catalog."""
