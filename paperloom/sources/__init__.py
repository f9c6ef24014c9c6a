"""Reading source trees and writing results."""
