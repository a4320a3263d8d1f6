"""Range splitting and plan choice on the driver."""
